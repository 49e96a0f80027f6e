"""Spans over streams with state: late spans, restarts, sessions that end."""

from datetime import datetime, timedelta

from corpusflow.streaming import progress as pg
from corpusflow.streaming import spans as sn

SCHEMA = "session long, seq long, at timestamp, name string, status string"
DAY = datetime(2024, 1, 1)


def events(*rows):
    return [(s, q, DAY + timedelta(minutes=m), n, t) for s, q, m, n, t in rows]


FIRST = events((1, 1, 0, "coverage_assessment", "running"), (1, 2, 1, "external_search.a", None), (2, 1, 0, "vector_recall", "success"))
SECOND = events((1, 3, 2, "vector_recall", "success"), (1, 4, 2, "keyword_recall", "success"), (1, 5, 3, "coverage_assessment", "success"), (1, 6, 3, "vector_recall", "error"))
THIRD = events((2, 2, 5000, "search_plan_generation", None), (1, 7, 5000, "prompt_build", "success"))
WANT = {1: [("vector_recall", "error"), ("keyword_recall", "success"), ("coverage_assessment", "success"), ("external_search.a", None), ("prompt_build", "success")], 2: [("vector_recall", "success"), ("search_plan_generation", None)]}


def listed(df):
    out = {}
    for r in df.orderBy("session", "position").collect():
        out.setdefault(r["session"], []).append((r["name"], r["status"]))
    return out


def test_late_spans_in_a_table(spark):
    assert listed(sn.ordered_spans(spark.createDataFrame(FIRST + SECOND + THIRD, SCHEMA))) == WANT


def fed(spark, tmp_path, parts, idle):
    folder, versions = str(tmp_path / "in"), []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        with pg.state_in_rocksdb(spark):
            pg.each_batch(sn.span_versions(stream, idle), str(tmp_path / "checkpoint"), lambda rows, batch: versions.extend(rows.collect()), "update")
    return versions


def test_late_spans_in_a_stream_that_starts_again(spark, tmp_path):
    """A checkpoint carries the state over restarts."""
    versions = fed(spark, tmp_path, (FIRST, SECOND, THIRD), 10**12)
    assert listed(sn.newest(spark.createDataFrame(versions, sn.SPANS))) == WANT and not any(v["closed"] for v in versions)


def test_sessions_end_and_begin_anew(spark, tmp_path):
    later = events((2, 2, 5000, "search_plan_generation", None))
    again = events((1, 7, 5001, "prompt_build", "success"))
    versions = fed(spark, tmp_path, (FIRST, SECOND, later, again), 3_600_000)
    ended = [v for v in versions if v["closed"] and v["session"] == 1]
    assert [v["name"] for v in sorted(ended, key=lambda v: v["position"])] == ["vector_recall", "keyword_recall", "coverage_assessment", "external_search.a"]
    assert [v["name"] for v in versions if v["session"] == 1 and v["version"] == 1 and v["name"] == "prompt_build"] == ["prompt_build"]
