"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def contracted(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, of the same components as ``edges`` (u long, v long), pulled towards the smallest ids.

    Every step replaces the neighbours of a node by their smallest one, counted by
    partial aggregation; a node with very many neighbours is only a frequent join
    key.  Steps run until the edges stay as they are, at most the logarithm squared
    of the longest path; each node then has one edge, to the smallest id of its
    component.  A given number of ``steps`` ends the search early, and a later call
    goes on from its result.  Each step's edges are a table in the shared folder.
    Loops and repeated edges change nothing.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen, done = materialize(pairs, "edges"), None, 0
    while steps is None or done < steps:
        done += 1
        if steps is None:
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if mark == seen or not mark[0]:
                break
            seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(now)
        now = after
    return now


def named(edges: DataFrame) -> DataFrame:
    """(id, component) of contracted edges: of each node its smallest neighbour, itself included.

    Rows with one component are connected; while the edges are not contracted to the
    end, a component may have several names.
    """
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return ends.groupBy("id").agg(F.min("component").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """For edges (u long, v long): one row (id, component) for each end, the component its smallest id; empty without edges."""
    return named(contracted(edges))
