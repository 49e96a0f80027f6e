"""The persisted keyword index and vector collections."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.bm25 import bm25
from corpusflow.operators.keyword_index import KeywordIndex
from corpusflow.operators.snapshots import Conflict, Snapshots
from corpusflow.operators.vector_store import Collection, vector_rows
from corpusflow.operators.vectors import nearest
from corpusflow.queries import retrieval

SOURCE = T.StructType().add("source", "string")


def scores(df):
    return {(r["query_id"], r["id"]): round(r["score"], 9) for r in df.collect()}


@pytest.fixture
def texts(spark):
    rows = [(k, f"title {k % 3}", " ".join(["graph deep-learning", "of the", "net " * (k % 4), f"w{k % 7}"]), f"s{k % 2}") for k in range(40)] + [(90, None, "", "s0"), (91, "", None, None)]
    return spark.createDataFrame(rows, "id long, title string, chunk_text string, source string")


def asked(spark):
    return spark.createDataFrame([(1, "graph"), (1, "net"), (2, "w3"), (2, "title"), (3, "deep learning"), (3, "nothing such"), (4, "learning of the net")], "query_id long, term string")


def test_index_follows_its_table(spark, texts, tmp_path):
    index, fields = KeywordIndex(spark, str(tmp_path / "i"), ("title", "chunk_text"), SOURCE, buckets=8, files=2), {"title": 8.0, "chunk_text": 1.0}

    def same(table):
        assert scores(index.bm25(asked(spark), fields)) == scores(bm25(table, fields, asked(spark), phrases=True))
        one = {"chunk_text": 1.0}
        assert scores(index.bm25(asked(spark), one, F.col("source") == "s1")) == scores(bm25(table, one, asked(spark), F.col("source") == "s1", phrases=True))
        assert index.consistent_with(table) and sorted(r["id"] for r in index.rows().collect()) == sorted(r["id"] for r in table.collect())

    assert index.statistics() == {"rows": 0, "tokens": {"title": 0, "chunk_text": 0}, "segments": 0} and index.bm25(asked(spark), fields).count() == 0
    index.upsert(texts)
    same(texts)
    changed = texts.where("id < 30").withColumn("chunk_text", F.concat("chunk_text", F.lit(" net w3")))
    index.upsert(changed)
    second = texts.where("id >= 30").union(changed)
    same(second)
    index.delete(second.where("id % 4 = 1 or id = 90").select("id"))
    third = second.where("not (id % 4 = 1 or id = 90)")
    same(third)
    index.delete(spark.createDataFrame([(12345,)], "id long"))
    back = texts.where("id = 5")
    index.upsert(back)
    same(third.union(back))
    before = index.statistics()
    index.compact()
    assert index.statistics() == before | {"segments": 1} and index.vacuum() > 3
    same(third.union(back))
    index.rebuild(texts)
    same(texts)


def test_search_reads_the_asked_buckets_only(spark, texts, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"), ("title", "chunk_text"), SOURCE, buckets=32)
    index.rebuild(texts)
    plan = index.bm25(spark.createDataFrame([(1, "graph")], "query_id long, term string"), {"chunk_text": 1.0})._jdf.queryExecution().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("bucket" in line.split("PartitionFilters")[1].split("]")[0] for line in filters)


def shuffled(spark, action):
    """Records that the stages of an action write for exchanges."""
    gateway = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    count = lambda found: sum(found.apply(k).shuffleWriteRecords() for k in range(found.size()))
    before = count(stages())
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return count(stages()) - before


def test_writing_an_index_shuffles_no_tokens(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"), ("text",), buckets=4)
    rows = spark.range(50).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.concat(F.lit("w"), k.cast("string"))), " ").alias("text"))
    assert shuffled(spark, lambda: index.rebuild(rows)) < 50 * 100
    asked = spark.createDataFrame([(1, "w7"), (1, "w7 w8"), (2, "w8 w7")], "query_id long, term string")
    got = {(r["id"], r["term"], r["f"]) for r in index.counted(asked, {"text": 1.0}).collect()}
    assert got == {(k, t, 1.0) for k in range(50) for t in ("w7", "w7 w8")}


def test_a_token_of_many_phrases_meets_them_as_pairs(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"), ("text",), buckets=4)
    index.rebuild(spark.range(20).select("id", F.concat(F.repeat(F.lit("the x "), 100), F.lit("the w3 end")).alias("text")))
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("the w"), F.col("id").cast("string"), F.lit(" end")).alias("term"))
    found = index.counted(asked, {"text": 2.0})
    rows = []
    assert shuffled(spark, lambda: rows.extend(found.collect())) < 20 * 101 * 10
    assert {(r["id"], r["term"], r["f"]) for r in rows} == {(k, "the w3 end", 2.0) for k in range(20)}


def test_one_writer_commits(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "s"))
    log.commit(0, {"a": 1})
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    log.commit(1, {"a": 3})
    assert log.read() == (2, {"a": 3})
    part = log.put(spark.range(3), "part")
    assert log.vacuum({"other"}) == 1 and part
    log.drop()
    assert log.read() == (0, {})
    log.drop()


META = T.StructType().add("library_id", "long").add("document_id", "long")


def vectors(spark, n=300, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"v{k:04d}", rng.normal(size=dims).tolist(), k % 3, k % 10) for k in range(n)], "id string, v array<double>, library_id long, document_id long")


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    rows = vectors(spark)
    store = Collection(spark, str(tmp_path / "c"), META)
    store.create(rows, cells=6)
    store.add(rows.where("library_id = 0"))
    state = store.snapshots.read()
    bad = rows.withColumn("v", F.when(F.col("id") == "v0299", F.lit(None)).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no vector"):
        store.add(bad)
    assert store.snapshots.read() == state and store.live().count() == 100
    store.add(rows)
    assert store.live().count() == 300
    store.delete((F.col("library_id") == 1) & (F.col("document_id") < 5))
    store.delete(F.col("library_id") == 77)
    left = rows.where("not (library_id = 1 and document_id < 5)")
    assert sorted(r["id"] for r in store.live().collect()) == sorted(r["id"] for r in left.collect())
    store.compact()
    assert store.live().count() == left.count()
    store.drop()
    assert store.snapshots.read() == (0, {})


def test_searches(spark, tmp_path):
    rows = vectors(spark)
    store = Collection(spark, str(tmp_path / "c"), META)
    store.create(rows, cells=10)
    store.add(rows)
    queries = rows.where("document_id = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    every = {r["id"]: r for r in rows.collect()}
    for metric, far in (("l2", lambda a, b: ((a - b) ** 2).sum()), ("inner", lambda a, b: -(a @ b)), ("cosine", lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b)))):
        got = store.search(queries, 5, metric, guard=F.col("library_id") == 2).collect()
        for q in {r["query_id"] for r in got}:
            want = sorted((round(far(np.array(every[q]["v"]), np.array(r["v"])), 9), i) for i, r in every.items() if r["library_id"] == 2)[:5]
            mine = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == q)
            assert [i for _, i in mine] == [i for _, i in want]
    exact = {(r["query_id"], r["id"]) for r in store.search(queries, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in store.search(queries, 10, probes=5).collect()}
    assert len(exact & near) >= 0.8 * len(exact) and {(r["query_id"], r["id"]) for r in store.search(queries, 10, probes=10).collect()} == exact


def test_nearest_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 0.0])]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    queries = base.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    base = base.coalesce(1)
    first = {(1, 1), (1, 2), (2, 1), (2, 2), (6, 6), (7, 7), (8, 8)}
    assert {(r["query_id"], r["id"]) for r in nearest(base, queries, "l2", 1).collect()} == first
    assert {(r["query_id"], r["id"]) for r in nearest(base, queries, "l2", 1, most_bytes=40).collect()} == first
    assert {(r["query_id"], r["id"]) for r in nearest(base.repartition(4), queries, "l2", 1).collect()} >= first
    assert nearest(base, queries.limit(0), "l2", 1).count() == 0 and nearest(base.limit(0), queries, "l2", 1).count() == 0


def test_a_task_tells_the_nearest_of_all_its_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        base = spark.range(0, 2000, 1, 1).select("id", F.array((F.col("id") % 500).cast("double"), F.lit(1.0)).alias("v"))
        queries = base.where("id % 400 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        every = nearest(base, queries, "l2", 3).collect()
        best = nearest(base, queries, "l2", 3, first=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # four copies of each vector: all ties at first place, of which the smallest three ids are enough
    assert len(every) == 5 * 4 and len(best) == 5 * 3
    assert {(r["query_id"], r["id"]) for r in best} == {(q, q % 500 + k) for q in range(0, 2000, 400) for k in (0, 500, 1000)}


def test_vectors_without_a_direction_hide_no_others(spark):
    base = spark.createDataFrame([(k, [0.0, 0.0]) for k in range(5)] + [(9, [1.0, 1.0])], "id long, v array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert [r["id"] for r in nearest(base, queries, "cosine", 3).collect()] == [9]


def test_recall_of_cells(spark, sf):
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.knn_l2(spark, sf).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in retrieval.vector_cells(spark, sf).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_rows_of_a_collection(spark):
    chunks = spark.createDataFrame([(1, 2, 0, " a text "), (1, 2, 1, "  "), (1, 3, 0, None)], "library_id long, document_id long, chunk_index long, chunk_text string")
    got = vector_rows(chunks, lambda df: df.withColumn("v", F.array(F.length("chunk_text").cast("double")))).collect()
    assert [(r["id"], r["v"], r["token_count"], r["section_title"], r["section_chunk_index"], r["indexable"]) for r in got] == [("library-1-doc-2-chunk-0", [6.0], 6, "", 0, True)]
