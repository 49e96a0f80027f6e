"""Phrases of the keyword index against SQL and against a plain count, where they repeat."""

import duckdb
from pyspark.sql import functions as F

from corpusflow.operators.keyword_index import KeywordIndex
from corpusflow.queries import oracle_sql, queries


def both(spark, folder, name, columns):
    """The rows of a query and those of its SQL over the tables in a folder."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = [tuple(r[c] for c in columns) for r in queries()[name](spark, str(folder)).collect()]
    return sorted(got), sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall())


def test_phrases_that_touch_are_counted_as_in_sql(spark, tmp_path):
    texts = ["with the with the", "with the with the with the", "So with the end, With-the\nbook; with thé", "with", "the with", None, "with the with the x with the with the", "with with the the"]
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = both(spark, tmp_path, "phrase_match", ("doc_id", "n_phrase"))
    assert got == want and got == [(0, 1), (1, 2), (2, 3), (6, 2), (7, 1)]


def test_terms_apart_in_each_field(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"), ("title", "text"), buckets=4)
    rows = spark.createDataFrame([(1, "a a a", "a a a a a a"), (2, "b c b", "c b c b c b"), (3, "a b", "b c")], "id long, title string, text string")
    index.rebuild(rows)
    asked = spark.createDataFrame([("a",), ("a a",), ("b c",), ("c b c",)], "term string")
    counted = lambda **how: {(r["id"], r["term"]): r["f"] for r in index.counted(asked, {"title": 10.0, "text": 1.0}, **how).collect()}
    assert counted(apart=True) == {(1, "a"): 23.0, (1, "a a"): 12.0, (2, "b c"): 11.0, (2, "c b c"): 1.0, (3, "a"): 10.0, (3, "b c"): 1.0}
    assert counted() == {(1, "a"): 36.0, (1, "a a"): 25.0, (2, "b c"): 12.0, (2, "c b c"): 2.0, (3, "a"): 10.0, (3, "b c"): 1.0}
    assert index.counted(asked, {"text": 1.0}, apart=True).where(F.col("term") == "a a").first()["f"] == 2.0


def test_phrases_of_all_items_are_asked(spark, tmp_path):
    texts = ["a graph of the net, a graph", "of the graph", None, "the net of the net"]
    spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, "a graph"), (7, "Of the net: of the net"), (20, "net"), (21, None), (33, "the graph"), (33, "the graph of")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got, want = both(spark, tmp_path, "fts_phrase_terms", ("query_id", "doc_id", "n_held"))
    assert got == want and got == [(0, 0, 2.0), (7, 0, 2.0), (7, 1, 1.0), (7, 3, 4.0), (33, 0, 1.0), (33, 1, 1.0)]


def test_all_items_are_traced(spark, tmp_path):
    docs = [(k, f"graph net w{k}\nof the net", "en", "src0", 5) for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, "w2 of" if k == 33 else "w1") for k in (0, 7, 33)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, [1.0, float(k)], 0) for k in (0, 1, 7)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["stage"]: r["result_count"] for r in queries()["hybrid_trace"](spark, str(tmp_path)).collect()}
    # two items have a vector and meet three; the texts of two hold w1, and all documents meet the third
    assert got == {"vector_recall": 6, "keyword_recall": 6, "hybrid_rrf": 10, "local_retrieval": 8}


def test_scores_are_summed_where_rows_lie(spark):
    from corpusflow.operators.bm25 import bm25, top

    docs = spark.createDataFrame([(k, f"the gpt {k % 3}") for k in range(9)], "id long, body string")
    asked = spark.createDataFrame([(1, "the"), (1, "gpt 1"), (2, "gpt")], "query_id long, term string")
    plan = top(bm25(docs, {"body": 1.0}, asked, phrases=True), 2, F.col("score"), F.col("id"))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line]
    assert len(dealt) == 1 and "hashpartitioning(query_id#" in dealt[0] and ", id#" not in dealt[0]
