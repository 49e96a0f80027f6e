"""Line deduplication: what a task holds, and lines without the white space that ends them."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.llm import line_dedup


def test_a_task_holds_little_beside_its_texts():
    """Tables of powers and hashes are made for a quarter of a million bytes at a time."""
    rng = random.Random(5)
    texts = pa.array([" ".join(f"w{rng.randrange(10**5)}" for _ in range(400)) + "." for _ in range(1500)])
    tracemalloc.start()
    total = sum(int(lines.words.sum()) for _, lines in line_dedup.in_blocks(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 600_000 and peak < 30e6


def test_texts_are_not_sorted_to_meet_their_marks(spark):
    docs = spark.createDataFrame([(k, "a b c. " * 40 + str(k)) for k in range(4)], "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_stripped_lines_are_those_of_the_text():
    rng = random.Random(6)
    ends = ["", " ", "\t", "\n", " \n", ". ", ". \n", "　 \n", "\x1f\n", " \n\n", "à ", "\x85\n", "   \n"]
    texts = ["".join(rng.choice(["a", "é", "wort", "你", "x."]) + rng.choice([" ", *ends]) for _ in range(rng.randrange(120))) for _ in range(300)]
    lines = line_dedup.Lines([t.encode() for t in texts], False)
    text, starts = lines.stripped()
    for n in range(len(texts)):
        a, b = lines.firsts[n], lines.firsts[n + 1]
        assert lines.of(n) == line_dedup.units(texts[n]) and "".join(lines.of(n)) == texts[n]
        assert text[starts[a] : starts[b]].decode() == "".join(x.rstrip() + "\n" for x in lines.of(n))


def test_copies_and_near_copies_of_a_lead_over_several_batches(spark):
    """One passage in more rows than a batch holds, each fourth with another line around it, keeps its first occurrence alone."""
    passage = "\n".join(" ".join(f"p{n}x{k}" for k in range(12)) for n in range(5))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, F.concat(F.lit("own"), F.col("id"), F.lit(" line\n"))).otherwise(F.lit("the same line\n")), F.lit(passage)).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, copies=1000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [k for k, t in got.items() if "p2x3" in t] == [0]
    assert all(got[k] == f"own{k} line\n" for k in range(4, 400, 4)) and len(got) == 400


def test_a_passage_is_compared_once(spark, monkeypatch):
    """A copy of 30 lines is one comparison, one of 80 lines three, also where it is found at the second look; all lines around that agree go."""
    counts, plain = {}, line_dedup.materialize

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    rng = random.Random(8)
    line = lambda n=9: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short, long_, later = ([line() for _ in range(n)] for n in (30, 80, 8))
    rows = [(k, "\n".join([line(), *passage, line()])) for k, passage in enumerate([short] * 6 + [long_] * 4)]
    rows += [(100 + k, "\n".join([line(), *later[k : k + 2], line()])) for k in range(7)]  # each two lines of the passage occur before
    rows += [(200 + k, "\n".join([line(), *later, line()])) for k in range(3)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["n_removed"] for k, r in got.items() if r["n_removed"]} == {**dict.fromkeys(range(1, 6), 30), **dict.fromkeys(range(7, 10), 80), 201: 8, 202: 8}
    assert all(got[k]["text"].splitlines() == [text.splitlines()[0], text.splitlines()[-1]] for k, text in rows if got[k]["n_removed"])
    firsts = 7 * 3 + 6  # no passage: what the eight lines share with the documents before, one or more runs in each
    assert 5 + 3 * 3 + 3 <= counts["picked"] <= 5 + 3 * 3 + firsts and counts["later"] == 2
