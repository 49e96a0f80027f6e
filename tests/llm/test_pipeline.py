"""The pipeline's stages on the smallest tables and on edge cases."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusflow.llm import language


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.schema == docs.schema
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["language", "line_dedup", "near_dup", "decontamination", "packing"]
    assert seen["packing"] == seen["decontamination"] <= seen["near_dup"] <= seen["line_dedup"] <= seen["language"]
    source = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(source)
    told = {r["doc_id"]: r["t"] for r in language.identify(source, model, out="t").collect()}
    assert seen["language"] == {i for i, t in told.items() if t["lang_pred"] != "und" and t["score"] > cp.bound(spark, model)}


def test_the_language_stage_rejects_what_it_does_not_know(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = [(-1, "\u041c\u043e\u0441\u043a\u0432\u0430 \u0441\u0442\u043e\u043b\u0438\u0446\u0430"), (-2, "\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d"), (-3, "123 !!"), (-4, None)]
    more = spark.createDataFrame([(i, t, None, "s", 1) for i, t in strange], docs.schema)
    left = {r["doc_id"] for r in cp.language(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert not left & {-1, -2, -3, -4} and left == {r["doc_id"] for r in cp.language(spark, docs, sf).select("doc_id").collect()}
    assert len(left) == docs.count()


ROWS = [
    (1, "some words that stand for a text of a few lines", "en", "x", 4), (1, "some words that stand for a text of a few lines", "en", "x", 4), (2, "", "en", "y", 0), (3, None, None, None, None),
    (4, " \t\n ", "de", "x", 4), (5, "very long " * 30_000, "en", "x", 300_000), (None, "a row without an id", "en", None, 19),
]


def test_stages_on_edge_cases(spark, sf, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns named as the operators' own, and an empty table."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("found", "h", "id", "count")})
    stages = dict(cp.STAGES)
    assert sorted(r["doc_id"] or -1 for r in stages["language"](spark, docs, sf).collect()) == [-1, 1, 1, 5]
    assert sorted(r["doc_id"] or -1 for r in stages["near_dup"](spark, docs, sf).collect()) == [-1, 1, 2, 3, 4, 5]
    assert {r["doc_id"] for r in stages["line_dedup"](spark, docs, sf).collect()} >= {2, 3, 4}
    packed = stages["packing"](spark, docs, sf).collect()
    assert sorted(r["doc_id"] or -1 for r in packed if r["piece"] == 0) == [-1, 1, 1, 2, 3, 4, 5]
    for name, stage in cp.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)


def test_near_dup_tells_texts_of_one_id_apart(spark, sf):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(2, a), (3, a), (3, b), (4, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in cp.near_dup(spark, docs, sf).collect()) == [(2, a), (3, b)]


def test_near_dup_keeps_one_of_a_group(spark, sf):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(5, text, 1), (3, text.upper(), 2), (3, text.upper(), 2), (9, "else", 3), (None, text, 4), (None, None, 5)], "doc_id long, text string, comp long")
    got = sorted((r["doc_id"] or -1, r["comp"]) for r in cp.near_dup(spark, docs, sf).collect())
    assert got == [(-1, 4), (-1, 5), (3, 2), (9, 3)]


def test_decontamination_stage(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean text"), (3, None)], "doc_id long, text string").withColumn("found", F.lit(1))
    assert sorted(r["doc_id"] for r in cp.decontamination(spark, docs, sf).collect()) == [2, 3]


def test_run(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_near_dup_takes_pairs_from_eight_tenths(spark, sf):
    words = [[f"w{k}_{n}" for n in range(120)] for k in range(30)]
    rows = [(2 * k + side, " ".join([*w[:100], *(w[100:110] if side else w[110:120])])) for k, w in enumerate(words) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")  # 96 of 116 shingles in common: 0.828
    assert sorted(r["doc_id"] for r in cp.near_dup(spark, docs, sf).collect()) == [2 * k for k in range(30)]
