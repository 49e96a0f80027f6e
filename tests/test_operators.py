"""Golden rows, differential tests against SQLite and loops, and properties."""

import difflib
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.config import Chunking
from corpusflow.functions import text as tx
from corpusflow.operators import catalog as ct
from corpusflow.operators import evidence as ev
from corpusflow.operators import federate as fd
from corpusflow.operators import split as sp
from corpusflow.operators.bm25 import bm25
from corpusflow.operators.fusion import fuse
from corpusflow.operators.rerank import rerank_with
from corpusflow.queries import citations, retrieval
from corpusflow.sources import files


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bm25_equals_sqlite(spark, sf):
    docs = retrieval.documents(spark, sf)
    fields = {"title": 8.0, "abstract": 3.0, "chunk_text": 1.0}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, abstract, chunk_text)")
    for r in docs.collect():
        con.execute("INSERT INTO t(rowid, title, abstract, chunk_text) VALUES (?, ?, ?, ?)", (r["id"] + 1, r["title"], r["abstract"], r["chunk_text"]))
    terms = spark.createDataFrame([(1, "the"), (1, "reder"), (1, "license"), (1, "anat")], "query_id long, term string")
    want = {i - 1: s for i, s in con.execute("SELECT rowid, bm25(t, 8.0, 3.0, 1.0) FROM t WHERE t MATCH '\"the\" OR \"reder\" OR \"license\" OR \"anat\"'")}
    got = {r["id"]: r["score"] for r in bm25(docs, fields, terms).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_citations(spark):
    got = {r["id"]: r["citation"] for r in citations.golden(spark).collect()}
    assert got == {
        1: "Ada Lovelace, Alan Turing. On Machines[J]. Mind, 1950, 59(236): 433-460.",
        2: "王小明, 李雷. 图神经网络[C]//中国计算机大会. 北京: 科学出版社, 2021-03-05: 1-9.",
        3: "A. B. A Thesis[D]. Paris: Some University, 2019.",
        4: "C. D. A Book[M]. New York: Press, 2001: 12.",
        5: "Preprint of things[EB/OL]. 2023-07. [2026-01-01]. DOI: 10.1000/abc. https://example.org/p.",
        6: "With own address[J/OL]. Journal of X. [2024-01-02]. DOI: 10.1000/xyz.",
        7: "No data at all.",
        8: "E F. Placeholder doi[C]//Workshop on Y. 2010.",
        9: "G. Letters, n.d, (4): e17.",
        10: "Report[R]. Agency, 2020-12.",
    }


def test_names_and_keywords(spark):
    df = spark.createDataFrame([("1. Ada Lovelace*, Alan Turing and ada lovelace; 王小明", "“deep nets” for the graph"), (None, "")], "a string, q string")
    got = df.select(tx.split_people(F.col("a")).alias("a"), tx.fallback_keywords(F.col("q")).alias("q")).collect()
    assert got[0]["a"] == ["Ada Lovelace", "Alan Turing", "王小明"]
    assert got[0]["q"] == ["deep nets", "for the graph"]
    assert got[1]["a"] == [] and got[1]["q"] == ["paper"]


def test_references_are_cut(spark):
    df = spark.createDataFrame([("Body.\n参考文献：\n[1] x",), ("Body.\nReferences\n[1] x",), ("All references here",)], "s string")
    assert [r[0].strip() for r in df.select(tx.drop_references(F.col("s"))).collect()] == ["Body.", "Body.", "All references here"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。;", max_size=300), st.integers(1, 40))
def test_splitter_properties(text, size):
    overlap = min(Chunking.overlap, size - 1)
    got = sp.split_text(text, size, overlap, Chunking().separators)
    assert all(len(c) <= size for c in got)
    assert all(c in text for c in got)
    assert {x for x in text if not x.isspace()} <= {x for c in got for x in c}


def test_greedy_keys_equal_a_loop(spark):
    data = [(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["c"]), (1, 4, []), (2, 1, ["c"]), (2, 2, ["c"])]
    df = spark.createDataFrame(data, "q long, pos long, keys array<string>")
    want, seen = [], {}
    for q, pos, keys in data:
        known = seen.setdefault(q, set())
        if keys and not known & set(keys):
            known |= set(keys)
            want.append((q, pos))
    assert rows(fd.keep_first_by_keys(df, "q", "pos"), "q", "pos") == want == [(1, 1), (1, 3), (2, 1)]


def test_merge_short_equals_a_loop(spark):
    data = [(1, k, s, t) for k, (s, t) in enumerate([("x", "aa"), ("x", "bb"), ("x", "c" * 8), ("y", "d"), ("x", "e"), ("x", "f")])] + [(2, 0, "x", "only")]
    got = {}
    for r in sp.merge_short(spark.createDataFrame(data, "id long, pos long, section string, text string"), 10, ["section"]).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["section"], r["text"]))
    assert got == {1: [("x", "aa\n\nbb"), ("x", "c" * 8), ("y", "d"), ("x", "e\n\nf")], 2: [("x", "only")]}


def test_islands_with_gaps_nulls_and_repeats(spark):
    data = [(1, 1, i, k, f"t{k}", 1.0 * k, k) for k, i in enumerate([3, 3, 5, 6, None, 7, None])]
    df = spark.createDataFrame(data, "query_id long, document_id long, chunk_index long, order long, chunk_text string, score double, rank long")
    got = rows(ev.merge_adjacent(df), "first_order", "n_chunks")
    assert got == [(0, 1), (1, 1), (2, 3), (4, 1), (6, 1)]


def test_fusion_counts_repeats_twice(spark):
    df = spark.createDataFrame([(1, 7, 0), (1, 7, 3), (1, 8, 1)], "query_id long, id long, rank long")
    got = {r["id"]: r["hybrid_score"] for r in fuse({"a": df}).collect()}
    assert abs(got[7] - (1 / 61 + 1 / 64)) < 1e-12 and abs(got[8] - 1 / 62) < 1e-12


def test_upsert_and_cascade(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = ct.upsert(base, new, ["k"])
    assert rows(once, "k", "v") == rows(ct.upsert(once, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(ct.patch(base, spark.createDataFrame([(2, None)], "k long, v string"), "k"), "k", "v") == [(1, "a"), (2, "b")]


def test_model_rerank_falls_back(spark):
    data = [(q, "some query", d, 0, r, "t", "", "text", "", "", "", [], "", "") for q, d, r in ((1, 10, 0), (1, 11, 1), (2, 12, 0))]
    df = spark.createDataFrame(data, "query_id long, query string, document_id long, chunk_index long, recall_rank long, title string, abstract string, chunk_text string, venue string, authors string, citation string, authors_list array<string>, year string, doi string")
    model = lambda c: c.where("query_id = 1").select("query_id", "document_id", "chunk_index", (F.col("document_id") * 1.0).alias("score"))
    got = {(r["query_id"], r["document_id"]): (r["rerank_rank"], r["rerank_provider"]) for r in rerank_with(df, 5, model).collect()}
    assert got == {(1, 11): (0, "model"), (1, 10): (1, "model"), (2, 12): (0, "rule")}


def test_fuzzy_titles_are_above_the_ratio(spark, sf):
    from corpusflow.queries.citations import title_fuzzy_match

    docs = {r["doc_id"]: r["text"].split("\n")[0][:120] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    norm = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    for r in title_fuzzy_match(spark, sf).collect():
        a, b = norm(docs[r["id"]]), norm(docs[r["ref"]])
        assert a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.88


def test_files_that_fail_are_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parser(content):
        if content == b"bad":
            raise ValueError("bad file")
        return content.decode().split("\f")

    found = files.full_text(files.parse_files(spark, str(tmp_path), parser))
    got = sorted((r["path"].rsplit("/", 1)[1], r["text"], r["error"]) for r in found.collect())
    assert got == [("a.pdf", "one\n\ntwo", None), ("b.pdf", "", "bad file")]
    assert files.scan_files(spark, str(tmp_path)).count() == 2


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_equal_titles_are_matched_by_equality(spark):
    from corpusflow.operators.cite import fuzzy_titles

    left = spark.range(600).select("id", F.when(F.col("id") < 599, "A common first line of copies").otherwise("A common first line of copied").alias("title"))
    right = spark.range(1000, 1600).select("id", F.lit("a common, first line: of copies").alias("title"))
    found = fuzzy_titles(left, right, 0.88)
    got = {r["id"]: (r["ref"], r["ratio"]) for r in found.collect()}
    assert {got[k] for k in range(599)} == {(1000, 1.0)} and got[599][0] == 1000 and 0.88 <= got[599][1] < 1.0
    rows = []

    def walk(plan):
        metrics = plan.metrics()
        if metrics.contains("numOutputRows"):
            rows.append(metrics.apply("numOutputRows").value())
        inner = plan.children() if not plan.nodeName().startswith("AdaptiveSparkPlan") else None
        for child in [plan.executedPlan()] if inner is None else [inner.apply(k) for k in range(inner.size())]:
            walk(child)
        if "QueryStage" in plan.nodeName():
            walk(plan.plan())

    walk(found._jdf.queryExecution().executedPlan())
    assert max(rows) <= 2 * 600  # all pairs of equal titles would be 359,400
