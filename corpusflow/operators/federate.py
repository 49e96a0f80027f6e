"""Federated search over paper catalogues: plans, subtasks, deduplication, quota."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import shared_folder


def subtasks(plans: DataFrame, per_source: int = 3) -> DataFrame:
    """``plans`` (plan_id, pos, keywords, sources): one row for each query and source, ``per_source`` at most of one source."""
    each = plans.select("plan_id", "pos", "keywords", F.explode("sources").alias("source"))
    w = Window.partitionBy("plan_id", "source").orderBy("pos")
    return each.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= per_source).drop("n_")


def normal_plans(plans: DataFrame, supported: list, most: int = 3) -> DataFrame:
    """Each distinct query of a plan once, with known sources (all if none is), a valid first day and a limit from 1 to 5.

    ``plans``: plan_id, pos, query, sources, date_from, limit (texts).
    """
    words = tx.query_keywords(F.col("query"))
    names = F.transform(F.split(F.coalesce("sources", F.lit("")), "[,; ]+"), lambda s: F.replace(F.lower(s), F.lit("-"), F.lit("_")))
    known = F.array_distinct(F.array_intersect(names, F.array(*map(F.lit, supported))))
    shaped = plans.select(
        "plan_id", "pos", words.alias("keywords"), F.when(F.size(known) > 0, known).otherwise(F.array(*map(F.lit, supported))).alias("sources"),
        tx.day_number(F.col("date_from")).alias("date_from"), F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.col("limit").try_cast("int"), F.lit(5)))).alias("limit"),
    ).where(F.size("keywords") > 0)
    same = Window.partitionBy("plan_id", F.lower(F.array_join("keywords", " "))).orderBy("pos")
    once = shaped.withColumn("n_", F.row_number().over(same)).where("n_ = 1")
    order = Window.partitionBy("plan_id").orderBy("pos")
    return once.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= most).drop("n_")


def record_keys(df: DataFrame) -> DataFrame:
    """``df`` and ``keys``: what tells a paper apart (doi, arxiv id, url, title, source with id)."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    doi = F.regexp_replace(tx.key(F.col("doi")), "^https?://doi.org/", "")
    source, ext = low(F.col("source")), low(F.col("external_id"))
    linked = F.regexp_extract(F.lower(F.concat_ws(" ", "url", "pdf_url")), r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)", 1)
    arxiv = F.when((source == "arxiv") & (ext != ""), ext).otherwise(linked)
    url, title = F.rtrim(low(F.col("url")), F.lit("/")), tx.key(F.col("title"))
    named = [("doi:", doi), ("arxiv:", arxiv), ("url:", url), ("title:", title)]
    parts = [F.when(v != "", F.concat(F.lit(p), v)) for p, v in named]
    parts.append(F.when((source != "") & (ext != ""), F.concat(source, F.lit(":"), ext)))
    return df.withColumn("keys", F.array_compact(F.array(*parts)))


def keep_first_by_keys(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows kept in order if none of their keys belongs to a row kept before; rows without keys go.

    A dropped row claims no keys, so this is neither a distinct nor connected
    components.  It goes in rounds: a row that is the first of those left on all its
    keys is kept, rows that share a key with a kept one go, and the rest is looked at
    again.  Rounds are as many as the longest chain of rows each of which decides the
    next; each ends in a table in the shared folder.  ``order`` must not repeat in a group.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/first-{uuid.uuid4().hex}"

    def table(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    each = df.select(group, F.col(order).alias("at_"), F.explode("keys").alias("key_")).distinct()
    left = table(each, "left-0")
    kept = [table(left.select(group, "at_").limit(0), "kept-0")]
    turn = 0
    while not left.isEmpty():
        turn += 1
        leader = left.groupBy(group, "key_").agg(F.min("at_").alias("first_"))
        seen = left.join(leader, [group, "key_"])
        first = table(seen.groupBy(group, "at_").agg(F.bool_and(F.col("at_") == F.col("first_")).alias("ok_")).where("ok_").select(group, "at_"), f"kept-{turn}")
        kept.append(first)
        claimed = left.join(first, [group, "at_"], "left_semi").select(group, "key_").distinct()
        gone = left.join(claimed, [group, "key_"], "left_semi").select(group, "at_").distinct()
        left = table(left.join(gone, [group, "at_"], "left_anti"), f"left-{turn}")
    every = reduce(DataFrame.union, kept)
    return df.join(every.withColumnRenamed("at_", order), [group, order], "left_semi").select(*df.columns)


def without_local(external: DataFrame, local: DataFrame) -> DataFrame:
    """External papers whose DOI and title are those of no local document; blank ones match nothing."""
    own = {k: local.select(tx.key(F.col(k)).alias("k_")).where("k_ <> ''").distinct() for k in ("doi", "title")}
    left = external
    for k in ("doi", "title"):
        left = left.withColumn("k_", tx.key(F.col(k))).join(own[k], "k_", "left_anti").drop("k_")
    return left


def from_day(df: DataFrame, day: Column, threshold: Column) -> DataFrame:
    """Rows of a day at or after the threshold; unknown days go; without a valid threshold all stay."""
    limit = F.try_to_date(threshold, "yyyyMMdd")
    return df.where(F.coalesce(limit.isNull() | (F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd") >= limit), F.lit(False)))


def fulltext(df: DataFrame) -> DataFrame:
    """Where the full text of a record is: pdf, download and landing addresses, and whether it is open."""
    arxiv = F.col("source") == "arxiv"
    pdf = F.when(arxiv, F.concat(F.lit("https://arxiv.org/pdf/"), F.col("external_id"))).otherwise(F.coalesce("pdf_url", F.lit("")))
    landing = F.when(arxiv, F.concat(F.lit("https://arxiv.org/abs/"), F.col("external_id"))).otherwise(F.coalesce("url", F.lit("")))
    return df.select("external_id", pdf.alias("pdf_url"), F.coalesce(F.nullif(pdf, F.lit("")), landing).alias("download_url"), landing.alias("landing_url"), (arxiv | (pdf != "")).alias("is_open_access"))


def ingest_decision(df: DataFrame) -> DataFrame:
    return df.withColumn("decision", F.when(F.coalesce("pdf_url", F.lit("")) != "", "queue_ingest").otherwise("answer_only"))


def rerank_or_pass(df: DataFrame, score: Column, quota: int) -> DataFrame:
    """The best ``quota`` of each query; queries with no more candidates than that keep their order."""
    w = Window.partitionBy("query_id")
    counted = df.withColumns({"n_": F.count("*").over(w), "score": F.round(score, 4)})
    key = F.when(F.col("n_") <= quota, -F.col("recall_rank").cast("double")).otherwise(F.col("score"))
    place = F.row_number().over(w.orderBy(F.desc("key_"), F.asc("recall_rank")))
    ranked = counted.withColumn("key_", key).withColumn("position", place.cast("long"))
    return ranked.where(F.col("position") <= quota).withColumn("reranked", F.col("n_") > quota).drop("n_", "key_")


def request_url(keywords: Column, start: Column, limit: Column) -> Column:
    query = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit('all:"'), k, F.lit('"'))), " AND ")
    return F.concat(F.lit("https://export.arxiv.org/api/query?search_query="), F.url_encode(query), F.lit("&start="), start.cast("string"), F.lit("&max_results="), F.least(limit * 4, F.lit(20)).cast("string"))
