"""Progress streams and traces: folding steps, counters, spans, frames."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_steps(events: DataFrame, keys: list, order: str, fields: list) -> DataFrame:
    """One row for each step: of each field the last value that is not null; placed where the step first appeared."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return events.groupBy(*keys).agg(F.min(order).alias("first_seq"), *last)


def running_counters(events: DataFrame, group: list, order: str) -> DataFrame:
    """Per source and event: how many tasks were announced, are done, remain; results and errors so far.

    ``events``: the group columns, the order, kind (planned, done, failed) and results.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda c: F.sum(c.cast("long")).over(w)
    ended = F.col("kind").isin("done", "failed")
    return events.withColumns(
        {
            "total": so_far(F.col("kind") == "planned"), "completed": so_far(ended), "results_so_far": F.sum(F.when(F.col("kind") == "done", F.col("results")).otherwise(0)).over(w),
            "errors": so_far(F.col("kind") == "failed"),
        }
    ).withColumn("remaining", F.col("total") - F.col("completed"))


def close_sources(counters: DataFrame, group: list) -> DataFrame:
    """The state of each source: running while tasks remain, error if there are errors and no result."""
    status = F.when(F.col("remaining") > 0, "running").when((F.col("errors") > 0) & (F.col("results") <= 0), "error").otherwise("success")
    return counters.withColumn("status", status).select(*group, "remaining", "errors", "results", "status")


def spans(events: DataFrame, keys: list) -> DataFrame:
    """Start, end and length of each span; ``events``: keys, ts, mark (start, finish) and error.

    A finish without a start makes a span that starts where it ends; one without a finish runs.
    """
    started = F.min(F.when(F.col("mark") == "start", F.col("ts")))
    ended = F.max(F.when(F.col("mark") == "finish", F.col("ts")))
    found = events.groupBy(*keys).agg(started.alias("s"), ended.alias("finished_at"), F.max("error").alias("error"))
    out = found.withColumn("started_at", F.coalesce("s", "finished_at")).drop("s")
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("error").isNotNull(), "error").otherwise("success")
    return out.withColumns({"elapsed_ms": F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at")), "status": status})


def frames(c: Column) -> Column:
    """The data of the frames of an event stream: comments and frames without data are left out."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n\n")
    data = F.transform(parts, lambda p: F.trim(F.array_join(F.transform(F.filter(F.split(p, "\n"), lambda line: line.startswith("data:")), lambda line: F.trim(line.substr(F.lit(6), F.length(line)))), "\n")))
    return F.filter(data, lambda d: d != "")


def joined_chunks(chunks: DataFrame, keys: list, order: str, text: str) -> DataFrame:
    """Pieces of a stream put together in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[text]), "").alias(text))
