"""How often the plans of queries on texts read and compute what is dear."""

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_are_located_and_cut_once(spark, sf):
    from corpusflow.queries import chunks as ch

    text = optimized(ch.section_pipeline(spark, sf))
    assert text.count("MapInArrow") == 1 and text.count("ArrowEvalPython") == 1


def test_documents_without_indexable_sections_are_cut_whole(spark):
    from corpusflow.plans.sections import section_chunks

    rows = [(1, 0, "a page of no section"), (1, 1, "and one more"), (2, 0, "alpha begins"), (2, 1, "x" * 30), (3, 0, "alpha hides"), (4, 0, " 　"), (5, 0, "\x1c"), (5, 1, "alpha")]
    pages = spark.createDataFrame(rows, "id long, page long, text string")
    told = F.struct(F.lit("method").alias("section_type"), F.lit("Alpha").alias("title"), F.lit("alpha").alias("start_anchor"), F.when(F.col("id") == 3, "no").otherwise("yes").alias("indexable"))
    got = {}
    for r in section_chunks(pages, lambda b: b.withColumn("sections", F.array(told)), 20).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["section_type"], r["section_chunk_index"], r["chunk_text"]))
    assert [k[0] for k in got[1]] == ["recursive"] * len(got[1]) and [k[1] for k in got[1]] == list(range(len(got[1])))
    assert {k[0] for k in got[2]} == {"method"} and [k[:2] for k in got[3]] == [("recursive", 0)] and 4 not in got and got[5] == [("method", 0, "alpha")]


def test_titles_are_looked_for_once(spark, sf):
    from corpusflow.queries import texts as te

    assert optimized(te.title_hint(spark, sf)).count("array_max") == 1
    assert optimized(te.venue_hint(spark, sf)).count("exists(") == 1


def test_texts_are_not_sorted_for_their_sections(spark, sf):
    from corpusflow.operators import split as sp
    from corpusflow.queries import chunks as ch

    text = plan(ch.section_ends(spark, sf))
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "abc")], "id long, text string")
    starts = spark.createDataFrame([(1, 4), (1, 0), (1, 40), (2, 0), (3, 3)], "id long, start_char long")
    assert sorted(map(tuple, sp.section_texts(starts, docs).collect())) == [(1, 0, 4, "one"), (1, 4, 13, "two three")]


def test_asked_tokens_are_met_where_rows_are_read(spark):
    from corpusflow.operators.bm25 import bm25

    docs = spark.createDataFrame([(1, "the the gpt 4"), (2, "4 gpt the"), (3, "none")], "id long, body string")
    asked = spark.createDataFrame([(1, "the"), (1, "gpt 4")], "query_id long, term string")
    scored = bm25(docs, {"body": 2.0}, asked, phrases=True)
    assert optimized(scored).count("rightHint=(strategy=broadcast)") + optimized(scored).count("leftHint=(strategy=broadcast)") >= 1
    assert optimized(scored).count("regexp_extract_all") == 3  # once for the statistics, and for each use of the postings, which share one shuffle
    assert {r["id"] for r in scored.collect()} == {1, 2}


def test_rows_of_a_crowded_node_have_no_copies(spark):
    import numpy as np

    from corpusflow.llm import near_dup as nd

    sizes = {1: 70, 2: 700, 3: 5000}
    rows = spark.createDataFrame([(k, i, n) for k, n in sizes.items() for i in range(n)], "node long, id long, count long")
    assert nd.blocks(rows.where("node < 3"), 4096).count() == 770 and nd.blocks(rows.where("node = 3"), 4096).count() == 10_000
    met = [(x, y) for xs, ys, once in nd.stripes(np.zeros(700, int), 5) for x in xs for y in ys if x < y or not once]
    assert len(met) == len(set(met)) == 700 * 699 // 2
    assert sum(len(x) * len(y) for x, y, _ in nd.stripes(np.repeat([1, 2], [300, 20]), 0)) == 6000


def test_state_is_called_once_for_all_events_of_a_batch():
    from datetime import datetime

    import pandas as pd

    from corpusflow.streaming import spans as sn

    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), []

        def getValueState(self, *_):
            return self.held

        getListState = getMapState = getValueState

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.append(-at)

    handle, order = Handle(), sn.SpanOrder(1000)
    order.init(handle)
    for k in range(2):
        frame = pd.DataFrame({"seq": range(100 * k, 100 * k + 100), "at": pd.to_datetime([datetime(2024, 1, 1 + k)] * 100), "name": [f"n{i % 7}" for i in range(99)] + ["vector_recall"], "status": ["s"] * 100})
        out = list(order.handleInputRows((1,), iter([frame]), None))
    assert len(out[0]) == 8 and handle.held.calls == 4 and len(handle.timers) == 1
