"""Nearest neighbours of a stated set of query vectors: blocks of queries against Arrow batches of vectors.

A task holds one batch of vectors and one block of queries and multiplies the two as
matrices, in tiles of a fixed size.  Of all its batches only what can be among the first k goes on,
with all ties, so the exchange before the final ranks moves about k rows for each query and task.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and queries of one tile of distances, rows and pairs that a task holds before it tells what it found, and pairs beyond those of k before they are sifted.
ROWS, QUERIES, MOST_ROWS, MOST_FOUND, SLACK = 2048, 512, 4_000_000, 4_000_000, 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def matrix(column: pa.Array) -> tuple:
    """(row numbers, matrix) of the vectors of each length; nulls and vectors with null entries are left out."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])
    found = {}
    for dims in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dims)
        m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        whole = ~np.isnan(m).any(1)
        found[int(dims)] = rows[whole], m[whole]
    return found


def measured(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    inner = a @ b.T
    if metric == "inner":
        return -inner
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - inner / (np.sqrt(aa) * np.sqrt(bb))
    if metric == "l2":
        return np.maximum(aa + bb - 2 * inner, 0.0)
    raise ValueError(f"unknown metric {metric}")


class Best:
    """The rows met so far that can be among the first ``k`` of each query: those up to the k-th rounded distance, with all ties."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit, self.held, self.parts = k, np.full(queries, np.inf), 0, []

    def meet(self, first: int, rows: np.ndarray, far: np.ndarray, kept: np.ndarray) -> None:
        """``far`` and its rounded form ``kept`` of ``rows`` to the queries from ``first`` on."""
        limit = self.limit[first : first + far.shape[1]]
        if len(kept) > self.k and np.isinf(limit).any():
            np.fmin(limit, np.partition(kept.T, self.k - 1, axis=1)[:, self.k - 1], out=limit)
        r, c = np.nonzero((kept <= limit) & (far < np.inf))
        self.parts.append((c + first, rows[r], far[r, c], kept[r, c]))
        self.held += len(r)
        if self.held > 4 * self.k * len(self.limit) + SLACK:
            self.sift()

    def sift(self) -> None:
        q, own, far, kept = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((kept, q))
        q, own, far, kept = q[order], own[order], far[order], kept[order]
        begin = np.searchsorted(q, np.arange(len(self.limit)))
        full = np.flatnonzero(np.r_[begin[1:], len(q)] - begin >= self.k)
        self.limit[full] = np.minimum(self.limit[full], kept[begin[full] + self.k - 1])
        take = kept <= self.limit[q]
        self.parts, self.held = [(q[take], own[take], far[take], kept[take])], int(take.sum())

    def drain(self, place: np.ndarray | None) -> list:
        """[(query, row, distance)] of what is held, which is then forgotten; the limits stay.  With the ``place`` of each row, of ties the first."""
        if self.parts:
            self.sift()
        if self.parts and place is not None:
            q, own, far, kept = self.parts[0]
            order = np.lexsort((place[own], kept, q))
            begin = np.searchsorted(q[order], np.arange(len(self.limit)))
            order = order[np.arange(len(q)) - begin[q[order]] < self.k]
            self.parts = [tuple(x[order] for x in self.parts[0])]
        out, self.parts, self.held = [p[:3] for p in self.parts], [], 0
        return out


def blocks_of(queries: DataFrame, most_bytes: int) -> list:
    """The queries in blocks of about ``most_bytes``, by a hash of their id; their number comes from one count."""
    told = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    count = max(1, -(-told[0] * (told[1] + 1) * 8 // most_bytes))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == k) for k in range(count)]


def nearest(base: DataFrame, queries: DataFrame, metric: str, k: int, cells: bool = False, digits: int = 9, most_bytes: int = 32_000_000, first: bool = False) -> DataFrame:
    """(query_id, id, distance): of ``base`` (id, v) for each query (query_id, q) at least all that are among its first k.

    Distances that agree to ``digits`` decimals tie, and ties are all kept, so a window
    over the result gives the exact first k in any order of ids; with ``first`` of ties only those
    with the smallest ids are kept, so copies of a vector add no rows.  With ``cells`` a query
    meets only the rows whose ``cell`` is in its array ``cells``.  Queries go to
    the tasks in blocks of a bounded size; each block reads ``base`` once.  Vectors that
    are null or empty or hold nulls, and those of another length than the query's, are not met.
    """

    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([queries.schema["query_id"], base.schema["id"], T.StructField("distance", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def against(block: DataFrame) -> DataFrame:
        rows = block.select("query_id", F.col("q").cast("array<double>").alias("q"), *(["cells"] if cells else [])).toArrow()
        ids = rows.column("query_id")
        asked = {d: (at, m) for d, (at, m) in matrix(rows.column("q").combine_chunks()).items()}
        names, probed = pa.array(ids.to_pylist(), kinds[0]), None
        if cells:
            lists = rows.column("cells").combine_chunks()
            numbers = lists.flatten().to_numpy(zero_copy_only=False)
            probed = np.zeros((len(names), int(numbers.max(initial=-1)) + 2), bool)
            probed[np.repeat(np.arange(len(names)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)), numbers] = True
        shipped = base.sparkSession.sparkContext.broadcast((asked, names, probed))

        def run(batches):
            asked, names, probed = shipped.value
            best = {d: Best(len(at), k) for d, (at, _) in asked.items()}
            found, pending = [], 0

            def told():
                out, rows = ([], [], []), pa.concat_arrays(found)
                place = pa.compute.rank(rows, tiebreaker="first").to_numpy() if first else None
                for d, part in best.items():
                    for j, own, far in part.drain(place):
                        out[0].append(names.take(pa.array(asked[d][0][j])))
                        out[1].append(rows.take(pa.array(own)))
                        out[2].append(pa.array(far))
                empty = [[pa.array([], kind)] for kind in (*kinds[:2], pa.float64())]
                return pa.RecordBatch.from_arrays([pa.concat_arrays(o or e) for o, e in zip(out, empty)], ["query_id", "id", "distance"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch.column(2).to_numpy(zero_copy_only=False) if cells else None
                for dims, (at, m) in matrix(batch.column(1)).items():
                    if dims not in asked:
                        continue
                    q_at, q = asked[dims]
                    # tiles of a fixed size: the distances that are held at a time depend on no number of rows or queries
                    for i in range(0, len(m), ROWS):
                        for j in range(0, len(q), QUERIES):
                            far = measured(metric, m[i : i + ROWS], q[j : j + QUERIES])
                            if cells:
                                near = probed[q_at[j : j + QUERIES]][:, np.minimum(cell[at[i : i + ROWS]], probed.shape[1] - 1)]
                                far = np.where(near.T, far, np.inf)
                            best[dims].meet(j, pending + at[i : i + ROWS], far, np.round(far, digits))
                found.append(batch.column(0).cast(kinds[1]))
                pending += batch.num_rows
                if pending > MOST_ROWS or any(part.held > MOST_FOUND for part in best.values()):
                    yield told()
                    found, pending = [], 0
            if pending:
                yield told()

        return base.select("id", F.col("v").cast("array<double>").alias("v"), *(["cell"] if cells else [])).mapInArrow(run, schema)

    return reduce(DataFrame.union, map(against, blocks_of(queries, most_bytes)))
