"""From ranked candidates to evidence: usefulness, adjacent chunks, quota, coverage."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_id(document_id: Column, chunk_index: Column) -> Column:
    return F.concat(F.lit("doc_"), document_id.cast("string"), F.lit("#chunk_"), F.coalesce(chunk_index.cast("string"), F.lit("unknown")))


def annotate(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` (document_id, chunk_index, verdict): a verdict on the chunk beats one on the document (chunk_index null)."""
    on_chunk = verdicts.where("chunk_index is not null").select("document_id", "chunk_index", F.col("verdict").alias("on_chunk"))
    on_doc = verdicts.where("chunk_index is null").select("document_id", F.col("verdict").alias("on_doc"))
    joined = candidates.join(on_chunk, ["document_id", "chunk_index"], "left").join(on_doc, "document_id", "left")
    return joined.withColumn("verdict", F.coalesce("on_chunk", "on_doc")).drop("on_chunk", "on_doc")


def keep_useful(candidates: DataFrame) -> DataFrame:
    """Of each query the useful rows, if it has any; else those not discarded."""
    useful = F.max((F.col("verdict") == "useful").cast("int")).over(Window.partitionBy("query_id"))
    rows = candidates.withColumn("any_", F.coalesce(useful, F.lit(0)))
    keep = F.when(F.col("any_") == 1, F.coalesce(F.col("verdict") == "useful", F.lit(False))).otherwise(F.coalesce(F.col("verdict") != "discard", F.lit(True)))
    return rows.where(keep).drop("any_")


def merge_adjacent(chunks: DataFrame) -> DataFrame:
    """Runs of chunks of one document whose index goes up by one, as one row each.

    ``chunks``: query_id, document_id, chunk_index, order, chunk_text, score, rank.  A
    row without an index is a run of its own.
    """
    w = Window.partitionBy("query_id", "document_id").orderBy(F.col("chunk_index").asc_nulls_last(), "order")
    before = F.lag("chunk_index").over(w)
    starts = F.when(F.col("chunk_index") == before + 1, 0).otherwise(1)
    marked = chunks.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "order", "chunk_text")))
    return marked.groupBy("query_id", "document_id", "run").agg(
        F.min("chunk_index").alias("chunk_index"),
        F.max("chunk_index").alias("chunk_end_index"),
        F.count("*").alias("n_chunks"),
        F.array_join(F.filter(F.transform(listed, lambda x: F.trim(x["chunk_text"])), lambda t: t != ""), "\n\n").alias("chunk_text"),
        F.max("score").alias("score"),
        F.min("rank").alias("best_rank"),
        F.min("order").alias("first_order"),
    )


def local_first(local: DataFrame, external: DataFrame, limit: int) -> DataFrame:
    """Local evidence up to the limit; external evidence fills what remains of it."""
    both = local.withColumn("origin", F.lit(0)).unionByName(external.withColumn("origin", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("origin", "order", "id"))
    return both.withColumn("position", place.cast("long")).where(F.col("position") <= limit)


def coverage(rows: DataFrame) -> DataFrame:
    """Per query: documents (by source id where no document id is known), highest and mean score."""
    known = F.countDistinct("document_id")
    score = F.col("score").try_cast("double")
    return rows.groupBy("query_id").agg(
        F.when(known > 0, known).otherwise(F.countDistinct("source_id")).alias("n_documents"),
        F.max(score).alias("max_score"),
        F.round(F.avg(score), 4).alias("avg_score"),
    )


def retrieval_mode(has_library: Column, n_local: Column, n_external: Column) -> Column:
    return (
        F.when(~has_library & (n_external == 0), "no_library")
        .when(n_external == 0, "local_only")
        .when(n_local == 0, "external_augmented")
        .otherwise("hybrid")
    )
