"""Traces, progress and streams on the events table."""

import uuid

from pyspark.sql import functions as F

from ..operators import trace as tr
from ..sources.shared import shared_folder
from ..streaming import progress as pg
from ..streaming import spans as sn
from .base import query, table

KIND = "CASE event_type WHEN 'view' THEN 'planned' WHEN 'click' THEN 'planned' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'other' END"
PROGRESS = f"SELECT event_id, user_id % 50 AS session, {KIND} AS kind, event_id % 7 AS results FROM events"


def progress(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "planned").when(t == "purchase", "done").when(t == "error", "failed").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("session"), kind.alias("kind"), (F.col("event_id") % 7).alias("results"))


W = "OVER (PARTITION BY session ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
COUNT = f"""SELECT event_id, session, CAST(sum(CASE WHEN kind = 'planned' THEN 1 ELSE 0 END) {W} AS BIGINT) AS total, CAST(sum(CASE WHEN kind IN ('done', 'failed') THEN 1 ELSE 0 END) {W} AS BIGINT) AS completed,
CAST(sum(CASE WHEN kind = 'done' THEN results ELSE 0 END) {W} AS BIGINT) AS results_so_far, CAST(sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) {W} AS BIGINT) AS errors FROM ({PROGRESS})"""


@query("trace_source_counters", f"SELECT *, total - completed AS remaining FROM ({COUNT})")
def trace_source_counters(spark, sf_dir):
    return tr.running_counters(progress(spark, sf_dir), ["session"], "event_id").drop("kind", "results")


CLOSE = f"""SELECT session, CAST(sum(CASE WHEN kind = 'planned' THEN 1 WHEN kind IN ('done', 'failed') THEN -1 ELSE 0 END) AS BIGINT) AS remaining, CAST(sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
CAST(sum(CASE WHEN kind = 'done' THEN results ELSE 0 END) AS BIGINT) AS results FROM ({PROGRESS}) GROUP BY session"""


@query("source_span_closure", f"SELECT *, CASE WHEN remaining > 0 THEN 'running' WHEN errors > 0 AND results <= 0 THEN 'error' ELSE 'success' END AS status FROM ({CLOSE})")
def source_span_closure(spark, sf_dir):
    kind = F.col("kind")
    counts = progress(spark, sf_dir).groupBy("session").agg(
        F.sum(F.when(kind == "planned", 1).when(kind.isin("done", "failed"), -1).otherwise(0)).alias("remaining"), F.count_if(kind == "failed").alias("errors"),
        F.sum(F.when(kind == "done", F.col("results")).otherwise(0)).alias("results"),
    )
    return tr.close_sources(counts, ["session"])


STEPS = "SELECT user_id AS session, event_id % 40 AS step, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS status, CASE WHEN event_id % 5 <> 0 THEN value END AS amount FROM events"


@query(
    "trace_step_fold",
    f"SELECT session, step, min(event_id) AS first_seq, arg_max(status, event_id) FILTER (WHERE status IS NOT NULL) AS status, arg_max(amount, event_id) FILTER (WHERE amount IS NOT NULL) AS amount FROM ({STEPS}) GROUP BY 1, 2",
)
def trace_step_fold(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), (e % 40).alias("step"), "event_id", F.when(e % 3 == 0, F.col("event_type")).alias("status"), F.when(e % 5 != 0, F.col("value")).alias("amount")
    )
    return tr.fold_steps(rows, ["session", "step"], "event_id", ["status", "amount"])


@query(
    "trace_span_durations",
    """SELECT session, step, coalesce(s, f) AS started_at, f AS finished_at, date_sub('millisecond', coalesce(s, f), f) AS elapsed_ms, CASE WHEN f IS NULL THEN 'running' WHEN e IS NOT NULL THEN 'error' ELSE 'success' END AS status FROM
(SELECT user_id AS session, event_id // 20 AS step, min(ts) FILTER (WHERE event_id % 2 = 0) AS s, max(ts) FILTER (WHERE event_id % 2 = 1) AS f, max(CASE WHEN event_type = 'error' THEN 'failed' END) AS e FROM events GROUP BY 1, 2)""",
)
def trace_span_durations(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.expr("event_id div 20").alias("step"), "ts", F.when(e % 2 == 0, "start").otherwise("finish").alias("mark"), F.when(F.col("event_type") == "error", "failed").alias("error")
    )
    return tr.spans(rows, ["session", "step"]).drop("error")


@query(
    "trace_latency_percentiles",
    "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS slowest FROM events GROUP BY event_type",
)
def trace_latency_percentiles(spark, sf_dir):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("slowest"))


@query("trace_sort", "SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(TRY_CAST(s AS DOUBLE), '-infinity'::DOUBLE) DESC, doc_id) AS position FROM (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS s FROM documents)) WHERE position <= 20")
def trace_sort(spark, sf_dir):
    from pyspark.sql import Window

    s = F.when(F.col("doc_id") % 6 == 0, "n/a").otherwise(F.col("n_chars").cast("string"))
    w = Window.partitionBy("source").orderBy(F.coalesce(s.try_cast("double"), F.lit(float("-inf"))).desc(), "doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").withColumn("position", F.row_number().over(w).cast("long"))
    return rows.where("position <= 20").select("doc_id", "position")


@query("span_hide_list", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'view') GROUP BY 1")
def span_hide_list(spark, sf_dir):
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("signup", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("failure_messages", "SELECT user_id AS job_id, string_agg(DISTINCT m, '|' ORDER BY m) AS messages FROM (SELECT user_id, 'e' || event_id % 4 AS m FROM events WHERE event_type = 'error') GROUP BY 1")
def failure_messages(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")).alias("m"))
    return errors.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("m")), "|").alias("messages"))


@query("sse_parse", "SELECT conv_id AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN turn % 3 = 2 THEN 'done' ELSE 'delta' END AS type, CASE WHEN turn % 3 <> 2 THEN text END AS content, CASE WHEN turn % 3 = 2 THEN text END AS answer FROM conversations")
def sse_parse(spark, sf_dir):
    """Turns as frames of an event stream that was cut anywhere, with comments and empty frames between them."""
    last = F.col("turn") % 3 == 2
    event = F.when(last, F.to_json(F.struct(F.lit("done").alias("type"), F.col("text").alias("answer")))).otherwise(F.to_json(F.struct(F.lit("delta").alias("type"), F.col("text").alias("content"))))
    frame = F.concat(F.when(F.col("turn") % 2 == 0, ": keep-alive\n\ndata:\n\n").otherwise(""), F.lit("data: "), event, F.lit("\r\n\r\n"))
    listed = F.array_sort(F.collect_list(F.struct("turn", frame.alias("f"))))
    sent = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("stream")).agg(F.array_join(F.transform(listed, lambda x: x["f"]), "").alias("body"))
    chunks = sent.select("stream", F.posexplode(F.regexp_extract_all("body", F.lit("(?s).{1,37}"), 0)).alias("seq", "body"))
    whole = tr.joined_chunks(chunks, ["stream"], "seq", "body")
    data = whole.select("stream", F.posexplode(tr.frames(F.col("body"))).alias("pos", "data"))
    parsed = data.withColumn("j", F.from_json("data", "type string, content string, answer string"))
    return parsed.select("stream", F.col("pos").cast("long").alias("pos"), "j.type", "j.content", "j.answer")


@query("delta_accumulate", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def delta_accumulate(spark, sf_dir):
    deltas = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("body"))
    return tr.joined_chunks(deltas, ["conv_id"], "turn", "body")


@query("group_chunks", "SELECT source, min(doc_id) AS first_seen, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def group_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    return rows.agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n"), ids.alias("ids"))


@query("source_type_counts", "SELECT source, CAST(count_if(lang = 'en') AS BIGINT) AS local, CAST(count_if(lang <> 'en') AS BIGINT) AS external FROM documents GROUP BY source")
def source_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("local"), F.count_if(F.col("lang") != "en").alias("external"))


@query("job_states", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS status FROM orders")
def job_states(spark, sf_dir):
    """A stored job that runs but that no live state knows has failed."""
    s = F.col("o_orderstatus")
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(s == "P", "running").when(s == "F", "failed").otherwise("done").alias("status"))
    live = stored.where("job_id % 2 = 1").select("job_id", F.lit(True).alias("live"))
    joined = stored.join(live, "job_id", "left")
    return joined.select("job_id", F.when((F.col("status") == "running") & F.col("live").isNull(), "failed").otherwise(F.col("status")).alias("status"))


@query("sync_progress", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS current_index, count(*) OVER (PARTITION BY l_orderkey) AS total_count FROM lineitem")
def sync_progress(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(w.orderBy("l_linenumber", "l_partkey")).cast("long").alias("current_index"), F.count("*").over(w).alias("total_count"))


def stream(spark, sf_dir):
    return pg.event_stream(spark, sf_dir, table(spark, sf_dir, "events").schema)


@query("stream_source_counters", "SELECT event_type, count(*) AS total, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, CAST(count_if(value > 0) AS BIGINT) AS with_value FROM events GROUP BY 1")
def stream_source_counters(spark, sf_dir):
    return pg.run_to_end(pg.source_counters(stream(spark, sf_dir)), "stream_source_counters_", "complete")


@query("stream_window_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    return pg.run_to_end(pg.windowed_counts(stream(spark, sf_dir)), "stream_window_counts_", "complete")


@query(
    "stream_session_windows",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, run""",
)
def stream_session_windows(spark, sf_dir):
    return pg.run_to_end(pg.session_windows(stream(spark, sf_dir)), "stream_session_windows_", "complete")


@query("stream_step_fold", "SELECT 's' || event_id % 30 AS step_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 > 0) AS status, count(*) AS n_updates, max(event_id) FILTER (WHERE event_id % 3 > 0) AS last_seq FROM events GROUP BY 1 HAVING max(event_id) FILTER (WHERE event_id % 3 > 0) IS NOT NULL")
def stream_step_fold(spark, sf_dir):
    """State is kept between micro-batches; the newest row of each step is its result.  Steps without any status are left out."""
    e = F.col("event_id")
    rows = stream(spark, sf_dir).select(F.concat(F.lit("s"), (e % 30).cast("string")).alias("step_id"), e.alias("seq"), F.when(e % 3 > 0, F.col("event_type")).alias("status"))
    out = pg.run_to_end(pg.folded_steps(rows), "stream_step_fold_", "update")
    newest = out.groupBy("step_id").agg(F.max_by("status", "n_updates").alias("status"), F.max("n_updates").alias("n_updates"), F.max_by("last_seq", "n_updates").alias("last_seq"))
    return newest.where("status is not null")


NAMES = ["memory_recall", "coverage_assessment", "search_plan_generation", "external_search.arxiv", "external_search.openalex", "vector_recall", "keyword_recall", "hybrid_rrf", "local_retrieval", "prompt_build"]
SPAN_SQL = f"""WITH e AS (SELECT user_id AS session, event_id AS seq, ({NAMES!r})[CAST(1 + event_id * 7 % 10 AS INTEGER)] AS name, CASE WHEN event_id % 4 > 0 THEN event_type END AS status FROM events),
f AS (SELECT session, name, min(seq) AS seq, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status FROM e GROUP BY 1, 2),
a AS (SELECT session, min(seq) AS stage FROM f WHERE name IN ('coverage_assessment', 'search_plan_generation') OR starts_with(name, 'external_search.') GROUP BY 1),
l AS (SELECT f.*, stage, name IN ('vector_recall', 'keyword_recall', 'hybrid_rrf', 'local_retrieval') AND coalesce(seq > stage, false) AS late FROM f LEFT JOIN a USING (session))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN late THEN stage ELSE seq END, NOT late, seq) - 1 AS position, name, status FROM l"""


def span_events(events):
    e = F.col("event_id")
    name = F.get(F.array(*map(F.lit, NAMES)), (e * 7 % 10).cast("int"))
    return events.select(F.col("user_id").alias("session"), e.alias("seq"), F.col("ts").cast("timestamp").alias("at"), name.alias("name"), F.when(e % 4 > 0, F.col("event_type")).alias("status"))


@query("late_span_order", SPAN_SQL)
def late_span_order(spark, sf_dir):
    return sn.ordered_spans(span_events(table(spark, sf_dir, "events")))


@query("stream_span_order", SPAN_SQL)
def stream_span_order(spark, sf_dir):
    """The same over a stream of four files and as many batches, with state between them."""
    events = table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    for k in range(4):  # the files follow each other in time
        part = F.floor((F.col("event_id") - low) * 4 / (high - low + 1))
        events.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    stream = span_events(pg.event_stream(spark, folder, events.schema, "*.parquet"))
    with pg.state_in_rocksdb(spark):
        versions = pg.run_to_end(sn.span_versions(stream, 10 * 365 * 86_400_000), "stream_span_order_", "update")
    return sn.newest(versions).select("session", "position", "name", "status")
