"""Reciprocal rank fusion of recall lists."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import top


def fuse(lists: dict, k: int = 60, limit: int = 10, tie: Column | None = None) -> DataFrame:
    """(query_id, id, hybrid_score, best_recall_rank, recall_source, rank).

    ``lists`` maps a source's name to (query_id, id, rank).  A key that a list holds
    twice counts twice.
    """
    every = reduce(DataFrame.unionByName, [df.select("query_id", "id", "rank", F.lit(name).alias("source")) for name, df in lists.items()])
    fused = every.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(float(k)) + F.col("rank") + 1)).alias("hybrid_score"),
        F.min("rank").alias("best_recall_rank"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("recall_source"),
    )
    return top(fused, limit, F.round("hybrid_score", 9).desc(), F.asc("best_recall_rank"), tie if tie is not None else F.asc("id"))
