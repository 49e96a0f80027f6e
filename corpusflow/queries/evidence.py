"""Evidence assembly on documents and labels."""

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import planning as pl
from .base import Made, query, table

LINES = """SELECT d.doc_id AS document_id, l.i AS chunk_index, l.line AS chunk_text, d.doc_id % 3 AS query_id, (d.doc_id * 7 + l.i * 3) % 11 AS rank, CAST((d.doc_id * 13 + l.i * 5) % 17 AS DOUBLE) AS score,
 d.doc_id * 1000 + l.i AS "order" FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) l JOIN documents d ON d.doc_id = l.doc_id WHERE (l.i * 7 + d.doc_id) % 4 <> 0"""


def lines(spark, sf_dir):
    """Lines of documents as chunks with gaps, and made-up ranks and scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    d, i = F.col("doc_id"), F.col("i").cast("long")
    return docs.where((F.col("i") * 7 + d) % 4 != 0).select(
        d.alias("document_id"), i.alias("chunk_index"), F.col("line").alias("chunk_text"), (d % 3).alias("query_id"), ((d * 7 + i * 3) % 11).alias("rank"),
        ((d * 13 + i * 5) % 17).cast("double").alias("score"), (d * 1000 + i).alias("order"),
    )


@query(
    "adjacent_chunk_merge",
    f"""WITH l AS ({LINES}), m AS (SELECT *, CASE WHEN chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS starts FROM l WINDOW w AS (PARTITION BY query_id, document_id ORDER BY chunk_index, "order")),
r AS (SELECT *, sum(starts) OVER (PARTITION BY query_id, document_id ORDER BY chunk_index, "order" ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT query_id, document_id, min(chunk_index) AS chunk_index, max(chunk_index) AS chunk_end_index, count(*) AS n_chunks,
 coalesce(string_agg(trim(chunk_text), chr(10) || chr(10) ORDER BY chunk_index) FILTER (WHERE trim(chunk_text) <> ''), '') AS chunk_text, max(score) AS score, min(rank) AS best_rank FROM r GROUP BY query_id, document_id, run""",
)
def adjacent_chunk_merge(spark, sf_dir):
    return ev.merge_adjacent(lines(spark, sf_dir)).drop("run", "first_order")


VERDICTS = """SELECT d.doc_id AS document_id, d.doc_id % 7 AS query_id, CASE WHEN l.quality = 1 THEN 'useful' WHEN l.toxic = 1 THEN 'discard' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def judged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), F.lit(None).cast("long").alias("chunk_index"), F.when(F.col("quality") == 1, "useful").when(F.col("toxic") == 1, "discard").alias("verdict")
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), (F.col("doc_id") % 7).alias("query_id"))
    return ev.annotate(docs, labels)


@query(
    "evidence_filter",
    f"""WITH v AS ({VERDICTS}), a AS (SELECT *, max(CASE WHEN verdict = 'useful' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS u FROM v)
SELECT query_id, document_id FROM a WHERE CASE WHEN u = 1 THEN coalesce(verdict = 'useful', false) ELSE coalesce(verdict <> 'discard', true) END""",
)
def evidence_filter(spark, sf_dir):
    return ev.keep_useful(judged(spark, sf_dir)).select("query_id", "document_id")


@query(
    "usefulness_annotation",
    "SELECT d.doc_id AS document_id, CASE WHEN d.doc_id % 10 = 3 THEN 'discard' ELSE CASE WHEN l.quality = 1 THEN 'useful' WHEN l.toxic = 1 THEN 'discard' END END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def usefulness_annotation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"))
    own = docs.where("document_id % 10 = 3").select("document_id", "chunk_index", F.lit("discard").alias("verdict"))
    whole = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), F.lit(None).cast("long").alias("chunk_index"), F.when(F.col("quality") == 1, "useful").when(F.col("toxic") == 1, "discard").alias("verdict")
    )
    return ev.annotate(docs, own.union(whole)).select("document_id", "verdict")


@query(
    "evidence_quota",
    """WITH b AS (SELECT doc_id % 50 AS query_id, doc_id AS id, doc_id AS "order", 0 AS origin FROM documents WHERE lang <> 'en' UNION ALL SELECT page_id % 50, page_id, page_id, 1 FROM pages)
SELECT query_id, id, origin, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, "order", id) AS position FROM b) WHERE position <= 10""",
)
def evidence_quota(spark, sf_dir):
    local = table(spark, sf_dir, "documents").where("lang <> 'en'").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("order"))
    external = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("query_id"), F.col("page_id").alias("id"), F.col("page_id").alias("order"))
    return ev.local_first(local, external, 10).select("query_id", "id", "origin", "position")


@query(
    "coverage_stats",
    """SELECT query_id, CASE WHEN count(DISTINCT document_id) > 0 THEN count(DISTINCT document_id) ELSE count(DISTINCT source_id) END AS n_documents, max(score) AS max_score, round(avg(score), 4) AS avg_score
FROM (SELECT doc_id % 20 AS query_id, CASE WHEN doc_id % 20 <> 5 THEN doc_id END AS document_id, source AS source_id, TRY_CAST(CASE WHEN doc_id % 9 = 0 THEN 'bad' ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE) AS score FROM documents) GROUP BY query_id""",
)
def coverage_stats(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        (d % 20).alias("query_id"), F.when(d % 20 != 5, d).alias("document_id"), F.col("source").alias("source_id"), F.when(d % 9 == 0, "bad").otherwise(F.col("n_chars").cast("string")).alias("score")
    )
    return ev.coverage(rows)


@query(
    "evidence_ids",
    "SELECT doc_id, 'doc_' || doc_id || '#chunk_' || coalesce(CAST(CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END AS VARCHAR), 'unknown') AS evidence_id FROM documents",
)
def evidence_ids(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", ev.evidence_id(d, F.when(d % 5 > 0, d % 5)).alias("evidence_id"))


@query(
    "retrieval_modes",
    """SELECT query_id, CASE WHEN query_id % 4 = 0 AND n_external = 0 THEN 'no_library' WHEN n_external = 0 THEN 'local_only' WHEN n_local = 0 THEN 'external_augmented' ELSE 'hybrid' END AS mode FROM
(SELECT doc_id % 100 AS query_id, count_if(lang = 'en') AS n_local, count_if(lang = 'es') AS n_external FROM documents GROUP BY 1)""",
)
def retrieval_modes(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 100).alias("query_id")).agg(F.count_if(F.col("lang") == "en").alias("l"), F.count_if(F.col("lang") == "es").alias("e"))
    return counts.select("query_id", ev.retrieval_mode(F.col("query_id") % 4 != 0, F.col("l"), F.col("e")).alias("mode"))


ANSWERS = Made(
    """SELECT item_id AS query_id, CASE item_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '{"sufficient": true, "reason_codes": ["a", " ", "b", "a"], "useful_local_evidence_ids": "doc_' || item_id || '"}'
WHEN 3 THEN '{"sufficient": "否", "recommended_external_limit": "3", "rationale": " r' || item_id || ' "}' WHEN 4 THEN '{"sufficient": 1, "reason_codes": "x", "recommended_external_limit": 99, "freshness_gap_detected": "YES", "useful_local_source_ids": ["s1", null, "s2"]}'
WHEN 5 THEN '[1]' ELSE '{"discarded_local_evidence_ids": [], "discarded_local_source_ids": ["d' || item_id || '"], "recommended_external_limit": 0}' END AS answer, CAST(item_id % 3 AS INTEGER) AS n_local, CAST(5 + item_id % 9 AS INTEGER) AS top_k FROM @benchmark"""
)


@query(
    "coverage_normalize",
    f"""SELECT query_id, enough AS sufficient, NOT enough AS should_search_external, CASE WHEN k IN (0, 1, 5) THEN CASE WHEN n_local > 0 THEN 'llm_coverage_assessment_failed' ELSE 'llm_coverage_assessment_failed|no_local_evidence' END WHEN k = 2 THEN 'a|b' WHEN k = 4 THEN 'x' ELSE 'llm_judged_insufficient' END AS reason_codes,
CAST(CASE WHEN enough THEN 0 WHEN k = 3 THEN 3 WHEN k = 6 THEN 1 ELSE 10 END AS INTEGER) AS recommended_external_limit, CASE k WHEN 2 THEN 'doc_' || query_id WHEN 4 THEN 's1|s2' ELSE '' END AS useful_ids, CASE k WHEN 6 THEN 'd' || query_id ELSE '' END AS discarded_ids,
k = 4 AS freshness_gap, CASE k WHEN 3 THEN 'r' || query_id ELSE '' END AS rationale, CASE WHEN k IN (0, 1, 5) THEN 'fallback' ELSE 'llm' END AS evaluator FROM (SELECT *, query_id % 7 AS k, CASE WHEN query_id % 7 IN (0, 1, 5) THEN n_local > 0 ELSE query_id % 7 = 2 END AS enough FROM {ANSWERS.sql})""",
)
def coverage_normalize(spark, sf_dir):
    """Answers of a judge: none, broken, with words and numbers for truth values, with ids under either name."""
    told = pl.coverage(ANSWERS.df(spark, sf_dir))
    joined = {c: F.array_join(c, "|") for c in ("reason_codes", "useful_ids", "discarded_ids")}
    return told.withColumns(joined)


PLANNED = Made(
    """SELECT item_id AS query_id, 'about "quoted words" and graphs ' || item_id AS question, CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"queries": ["Graph  nets", "graph nets", " ", "x"], "limit": "2", "sortby": "submittedDate", "orderby": "ascending", "date_from": "2020"}'
WHEN 2 THEN '{"query": "ti:deep learning ' || item_id || ' AND (vision)", "keywords": ["unread"], "sortby": "odd", "date_from": "soon"}' WHEN 3 THEN '{"keywords": [], "limit": 99}' WHEN 4 THEN 'broken' ELSE '{"search_query": "one; two", "limit": -4}' END AS answer, item_id % 4 = 0 AS fresh FROM @benchmark"""
)


@query(
    "search_plan_fallback",
    f"""SELECT query_id, CASE k WHEN 1 THEN 'Graph nets|graph nets|x' WHEN 2 THEN 'deep learning ' || query_id || '|vision' WHEN 5 THEN 'one|two' ELSE 'quoted words|about|and graphs ' || query_id END AS words, CASE WHEN k = 1 THEN '20200101' WHEN fresh THEN '20240101' END AS date_from,
CASE WHEN k = 1 OR fresh THEN 'submittedDate' ELSE 'relevance' END AS sort, CASE WHEN k = 1 THEN 'ascending' ELSE 'descending' END AS "order", CAST(CASE k WHEN 1 THEN 2 WHEN 5 THEN 1 ELSE 5 END AS INTEGER) AS "limit", k IN (1, 2, 5) AS by_model FROM (SELECT *, query_id % 6 AS k FROM {PLANNED.sql})""",
)
def search_plan_fallback(spark, sf_dir):
    """Plans of a model under any of their names, and the plan of the question where there is none."""
    return pl.one_plan(PLANNED.df(spark, sf_dir), 2026).withColumn("words", F.array_join("words", "|"))
