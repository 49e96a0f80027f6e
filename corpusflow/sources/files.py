"""Files with their content hash, and text out of them through a parser that is passed in."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, content_hash) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def parse_files(spark: SparkSession, folder: str, parser: Callable[[bytes], list], pattern: str = "*.pdf", only: DataFrame | None = None) -> DataFrame:
    """(path, content_hash, pages, error): a file that cannot be parsed is a row with an error, never a failed task.

    ``only`` (path) limits the work to some files, before anything is parsed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    if only is not None:
        found = found.join(only, "path", "left_semi")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages, errors = [], []
            for content in frame["content"]:
                try:
                    pages.append(parser(bytes(content)))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever a parser raises is data here
                    pages.append([])
                    errors.append(str(error) or type(error).__name__)
            yield pd.DataFrame({"path": frame["path"], "content_hash": frame["content_hash"], "pages": pages, "error": errors})

    hashed = found.select("path", "content", F.sha2("content", 256).alias("content_hash"))
    return hashed.mapInPandas(parse, "path string, content_hash string, pages array<string>, error string")


def full_text(df: DataFrame) -> DataFrame:
    """The pages that are not blank, two line ends between them; without any, an error."""
    text = F.trim(F.array_join(F.filter("pages", lambda p: F.trim(p) != ""), "\n\n"))
    return df.withColumn("text", text).withColumn("error", F.coalesce("error", F.when(F.col("text") == "", "no text in file")))
