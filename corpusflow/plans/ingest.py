"""Incremental ingestion: scan, hash, classify, parse what is new, cut into chunks, index."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doi_in, infer_type, language_of, url_in, year_in
from ..functions.tokens import index_text
from ..operators.catalog import classify_files, job_summary
from ..operators.hints import with_hints
from ..operators.split import recursive_split
from ..sources.files import full_text, parse_files, scan_files


def metadata(docs: DataFrame) -> DataFrame:
    """Bibliographic hints by rule for ``docs`` (id, text)."""
    hints = with_hints(docs).withColumns({"doi": doi_in(F.col("text")), "url": url_in(F.col("text")), "year": year_in(F.substring("text", 1, 4000))})
    return hints.withColumns({"document_type": infer_type(F.col("title"), F.col("venue"), F.col("url")), "language": language_of(F.col("text"))})


def ingest(spark: SparkSession, folder: str, stored: DataFrame, parser: Callable[[bytes], list], chunk_size: int, pattern: str = "*.pdf") -> tuple:
    """(documents, chunks, items, summary) of one run over a folder.

    Files whose content is stored and healthy are not parsed again; a file that
    cannot be parsed is an item with its error and fails nothing else.
    """
    classified = classify_files(scan_files(spark, folder, pattern), stored)
    todo = classified.where("state <> 'duplicate'").select("path")
    parsed = full_text(parse_files(spark, folder, parser, pattern, only=todo))
    docs = metadata(parsed.where("error is null").select(F.col("content_hash").alias("id"), "path", "text"))
    cut = recursive_split(docs.select("id", "text"), chunk_size)
    chunks = cut.join(docs.select("id", "title", "venue"), "id").withColumn("search_text", index_text(F.col("title"), F.col("chunk_text")))
    status = F.when(F.col("state") == "duplicate", "duplicate").when(F.col("error").isNull() & F.col("text").isNotNull(), "saved").otherwise("failed")
    items = classified.join(parsed.select("path", "text", "error"), "path", "left").select(F.lit(1).alias("job_id"), "path", status.alias("status"), "error")
    return docs, chunks, items, job_summary(items)
