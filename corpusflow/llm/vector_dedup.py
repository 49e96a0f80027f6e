"""Operator 5: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned that turns directions into balanced binary codes (Gong and
Lazebnik, 2011).  Codes are cut into substrings, each an index of its own (Norouzi
et al., 2012): a vector looks itself up under its own substring and under those
that differ in one bit.  A pair counts in the first table where it meets, so no
pair is seen twice; candidates whose whole codes are near are reranked with the
original vectors in double precision.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components


class Quantiser:
    """Rotations of centred unit vectors; each gives ``dims`` bits."""

    def __init__(self, sample: np.ndarray, rotations: int, rounds: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(dims)
        centred = sample - self.mean
        self.rotations = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
            for _ in range(rounds if len(sample) > 1 else 0):
                codes = np.where(centred @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(centred.T @ codes)
                turn = u @ v
            self.rotations.append(turn)

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return np.hstack([(unit - self.mean) @ turn >= 0 for turn in self.rotations])


def substrings(bits: np.ndarray, width: int) -> np.ndarray:
    """The numbers of the substrings of each code, one column for each table."""
    tables = bits.shape[1] // width
    weights = 1 << np.arange(width, dtype=np.int64)
    return bits[:, : tables * width].reshape(len(bits), tables, width) @ weights


def turns(width: int, dims: int, cosine: float, least: int, miss: float = 0.01) -> int:
    """How many rotations give enough tables of ``width`` bits that a pair at the threshold meets in all but the share ``miss``."""
    bit = float(np.arccos(min(1.0, max(-1.0, cosine)))) / np.pi
    meets = (1 - bit) ** width + width * bit * (1 - bit) ** (width - 1)
    tables = 1 if meets >= 1 else int(np.ceil(np.log(miss) / np.log1p(-meets)))
    return max(least, -(-tables * width // dims))


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, sample: int = 4000, rotations: int = 2, rounds: int = 30, width: int | None = None, far: float = 0.32, seed: int = 5
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors`` (vec_id, embedding, label).

    Only vectors of an equal label that is not null are compared.  A vector that
    is null, empty or zero, or holds a null or a component that is not finite,
    links with nothing, nor do vectors of different lengths with each other.  Equal
    vectors of a label are one class, found by grouping, and count as linked with
    each other; so a vector that fills a third of the table is one row of the
    search, which runs once for each length.  Rotations are fitted on about ``sample``
    vectors (those with the smallest id hash); all vectors are indexed.  ``width`` bits of a substring
    follow the number of vectors, so that a bucket stays small at any size, and
    there are ``rotations`` or as many more as find a pair at the threshold with 0.99; codes
    that differ in more than the share ``far`` of their bits are not reranked.
    Rows that share a vec_id are each judged by their own vector.  Vectors that differ
    by a positive factor only are one class too, as their cosine is 1; classes are
    numbered by a 64-bit hash of label and scaled vector.  Only the three columns are
    read, so others may have any name.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # scaled by the largest component first, so that no square leaves the range of a double
    scaled = F.transform("e", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    usable = F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    base = base.withColumn("ok", usable)
    top = F.array_max(F.transform("e", F.abs))
    good = base.where("ok").withColumn("top", top).withColumn("e", scaled).withColumn("key", F.xxhash64("label", "e"))
    classes = good.groupBy("key").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    classes = materialize(classes.withColumn("norm", norm).withColumnRenamed("key", "id"), "vectors")
    lengths = sorted((r["dims"], r["count"]) for r in classes.groupBy(F.size("e").alias("dims")).count().where("count > 1").collect())

    def search(dims: int, count: int) -> DataFrame:
        """(label, a, b) of the candidate pairs among the ``count`` vectors of one length."""
        these = classes.where(F.size("e") == dims)
        limit = int((1 << 30) * min(1.0, sample / max(count, 1)))
        rows = these.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < limit).select("id", "e", "norm").collect()
        drawn = np.array([np.array(r["e"]) / r["norm"] for r in sorted(rows, key=lambda r: r["id"])]).reshape(-1, dims)
        bits_ = width or min(24, max(10, int(np.ceil(np.log2(max(count, 2)))) - 3))
        bits_ = min(bits_, dims * rotations)
        n_turns = turns(bits_, dims, cosine, rotations)
        shipped = spark.sparkContext.broadcast(Quantiser(drawn, n_turns, rounds, seed))

        def coded(probe):
            def run(batches):
                quantiser = shipped.value
                for batch in batches:
                    e = np.array(batch.column("e").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
                    bits = quantiser.bits(e / batch.column("norm").to_numpy()[:, None])
                    parts, packed = substrings(bits, bits_), np.packbits(bits, axis=1)
                    n, tables = parts.shape
                    flips = np.concatenate(([0], 1 << np.arange(bits_))) if probe else np.zeros(1, dtype=np.int64)
                    keys = parts[:, :, None] ^ flips[None, None, :]
                    row = np.repeat(np.arange(n), tables * len(flips))
                    table = np.tile(np.repeat(np.arange(tables), len(flips)), n)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(at), pa.array(table.astype(np.int32)), pa.array(keys.reshape(-1)), batch.column("id").take(at), pa.array([x.tobytes() for x in packed], pa.binary()).take(at)],
                        ["label", "tbl", "key", "id", "code"],
                    )

            label = classes.schema["label"].dataType.simpleString()
            return these.select("label", "id", "e", "norm").mapInArrow(run, f"label {label}, tbl int, key long, id long, code binary")

        asked = coded(True).withColumnsRenamed({"id": "b", "code": "code_b"})
        filed = coded(False).withColumnsRenamed({"id": "a", "code": "code_a"})
        most = int(far * dims * n_turns)

        def meet(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.unpackbits(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)[:, : dims * n_turns] for c in ("code_a", "code_b"))
                differ = x != y
                tables = differ.shape[1] // bits_
                close = differ[:, : tables * bits_].reshape(len(x), tables, bits_).sum(2) <= 1
                keep = (close.argmax(1) == batch.column("tbl").to_numpy()) & (differ.sum(1) <= most)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("label", "a", "b")], ["label", "a", "b"])

        label = classes.schema["label"].dataType.simpleString()
        return filed.join(asked, ["label", "tbl", "key"]).where("a < b").select("label", "tbl", "a", "b", "code_a", "code_b").mapInArrow(meet, f"label {label}, a long, b long")

    label = classes.schema["label"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"label {label}, a long, b long")
    met = reduce(DataFrame.union, [search(dims, count) for dims, count in lengths], nothing)
    x = classes.select("label", F.col("id").alias("a"), F.col("e").alias("x"), F.col("norm").alias("nx"), F.col("size").alias("size_a"))
    y = classes.select("label", F.col("id").alias("b"), F.col("e").alias("y"), F.col("norm").alias("ny"), F.col("size").alias("size_b"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    linked = met.join(x, ["label", "a"]).join(y, ["label", "b"]).where((F.size("x") == F.size("y")) & (dot / (F.col("nx") * F.col("ny")) >= cosine))
    links = materialize(linked.select("label", "a", "b", "size_a", "size_b"), "links")
    ends = links.select("label", F.col("a").alias("id"), F.col("size_b").alias("n")).union(links.select("label", "b", "size_a"))
    degree = ends.groupBy("label", "id").agg(F.sum("n").alias("others"))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("id", "vec_id", "size").join(groups, "id", "left").join(degree.drop("label"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = named.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    known = named.join(least, "group").select(F.col("id").alias("key"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    found = good.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = base.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
