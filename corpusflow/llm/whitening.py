"""Operator 11: whitening of embeddings by Chebyshev-filtered subspace iteration.

A block of directions meets the data once a pass: every task centres its rows and
adds up Xᵀ(XQ), and the sums are merged in a tree, so a pass sends the driver at
most ``MERGES`` matrices of dimensions by block width whatever the number of rows.
A few Lanczos steps bound the spectrum from below.  The three-term recurrence of
the Chebyshev polynomials, run over such passes, damps everything between that
bound and the smallest Ritz value of the block (Zhou and Saad, 2007); QR and
Rayleigh-Ritz follow, until every wanted pair has a residual that certifies it.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct

MERGES = 32
DOUBLES = T.ArrayType(T.DoubleType())
WHITENED = T.StructType().add("n", "long").add("deviation", "long").add("whitened", DOUBLES).add("explained", DOUBLES).add("identity_error", "double")
SHIFT, SCALE, LARGEST = 1_000_000, 64, 2.0**52


class Whitening(NamedTuple):
    """What ``fit`` learns of the vectors of one length."""

    n: int
    sums: list
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def entries(column: pa.Array) -> dict:
    """For each length: the row numbers of the usable vectors, and their entries as whole numbers."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    found = {}
    for dims in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dims)
        c = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        with np.errstate(invalid="ignore", over="ignore"):
            usable = (np.abs(c * SCALE) < LARGEST).all(1)
        if usable.any():
            found[int(dims)] = rows[usable], np.floor(c[usable] * SCALE).astype(np.int64) + SHIFT
    return found


def from_mean(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n*x - S exactly: in 64 bits where they hold it, in Python's integers beyond."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        x = x.astype(object)
        return x * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def squares(far: np.ndarray) -> list:
    """The exact sum of squares of each row; None where a long cannot hold it."""
    if far.dtype != object and far.size and far.shape[1] * int(np.abs(far).max()) ** 2 < 1 << 63:
        return (far * far).sum(1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in far]
    return [t if t < 1 << 63 else None for t in totals]


def column_sums(vectors: DataFrame) -> dict:
    """n and the exact per-dimension sums S, for each length of vectors."""

    def add(batches):
        for batch in batches:
            for dims, (_, x) in entries(batch.column(0)).items():
                # two parts, so that no sum of 64 bits runs over
                total = [(int(a) << 26) + int(b) for a, b in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([len(x)] * dims, pa.int64()), pa.array(total, pa.decimal128(38, 0))],
                    ["dims", "place", "n", "total"],
                )

    rows = vectors.mapInArrow(add, "dims int, place int, n long, total decimal(38,0)").groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["dims"], r["place"])):
        found.setdefault(r["dims"], (int(r["n"]), []))[1].append(int(r["total"]))
    return found


def summed(vectors: DataFrame, dims: int, n: int, sums: list, work) -> np.ndarray:
    """The sum of ``work(centred rows)`` over all vectors of one length; work gives a flat array of doubles."""

    def total(parts):
        whole = None
        for p in parts:
            whole = p if whole is None else whole + p
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["part"])

    def each(batches):
        rows = max(1, 1_000_000 // dims)
        blocks = (batch.column(0).slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        return total(work(from_mean(found[dims][1], n, sums).astype(np.float64) / n) for found in map(entries, blocks) if dims in found)

    def merge(batches):
        return total(np.frombuffer(p.as_buffer()) for batch in batches for p in batch.column(0))

    rows = vectors.mapInArrow(each, "part binary").repartition(MERGES).mapInArrow(merge, "part binary").collect()
    return sum(np.frombuffer(r["part"]) for r in rows)


def lower_bound(times, dims: int, steps: int, rng) -> float:
    """A value below the spectrum: the least Ritz value of some Lanczos steps less the norm of what is left, 0 at least."""
    q = rng.normal(size=dims)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dims)):
        w = times(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ w))
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    inner = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(inner)[0]) - betas[-1])


def filtered(times, block: np.ndarray, product: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the covariance, small on [low, high] and scaled at ``top``; ``product`` is the first pass."""
    middle, half = (low + high) / 2, (high - low) / 2
    first = scale = half / (top - middle)
    before, now = block, (product - middle * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - before * (scale * following)
        scale = following
    return now


def bearable(values: np.ndarray, want: int, low: float, high: float, degree: int) -> int:
    """The largest degree, ``degree`` at most, that raises the first value over the last wanted one by 1e10 at most.

    Beyond, the rounding of a column along the first directions would drown what is wanted.
    """
    middle, half = (low + high) / 2, (high - low) / 2
    grows = [np.arccosh(max(1.0, (v - middle) / half)) for v in (values[0], values[max(want, 1) - 1])]
    return max(1, min(degree, int(np.log(1e10) / max(grows[0] - grows[1], 1e-9))))


def top_pairs(times, dims: int, want: int, guard: int, degree: int, rounds: int, seed: int) -> tuple:
    """The ``want`` largest eigenpairs, certified; fewer where the rest has no variance.

    A pair counts once its residual is 1e-12 of the gap to the next Ritz value, or as
    small as rounding lets it be.  A block that does not get there in ``rounds`` is
    widened to all dimensions, where Rayleigh-Ritz is exact.
    """
    rng, eps = np.random.default_rng(seed), np.finfo(float).eps
    width = min(dims, want + guard)
    low = lower_bound(times, dims, 10, rng) if width < dims else 0.0
    block = np.linalg.qr(rng.normal(size=(dims, width)))[0]
    for turn in range(rounds + 3):
        if turn == rounds and width < dims:
            width = dims
            block = np.linalg.qr(np.hstack([block, rng.normal(size=(dims, dims - block.shape[1]))]))[0]
        product = times(block)
        inner = block.T @ product
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, block, product = values[::-1], block @ turned[:, ::-1], product @ turned[:, ::-1]
        some = min(want, int((values > 8 * dims * eps * max(values[0], 0)).sum()))
        apart = np.abs(values[:, None] - values[None, :]) + np.diag(np.full(width, np.inf))
        residual = np.linalg.norm(product - block * values, axis=0)
        floor = 4 * eps * np.sqrt(dims) * abs(values[0])
        if (residual <= np.maximum(1e-12 * apart.min(1), floor))[:some].all() or (width == dims and turn > 0):
            break
        if width == dims:
            block = np.linalg.qr(block)[0]
            continue
        high = max(values[-1], 1e-10 * values[0])
        low = min(low, 0.999 * high)
        block = np.linalg.qr(filtered(times, block, product, low, high, values[0], bearable(values, some, low, high, degree)))[0]
    signs = np.sign(block[np.abs(block).argmax(0), np.arange(width)])
    return (block * signs)[:, :some], values[:some]


def fit(vectors: DataFrame, column: str = "embedding", want: int = 32, guard: int = 16, degree: int = 10, rounds: int = 40, seed: int = 11) -> dict:
    """A ``Whitening`` for each length of vectors, from all usable rows.

    The vectors are read again in each pass and nothing is stored, so ``vectors``
    should be a table and not a costly plan.
    """
    rows = vectors.select(F.col(column).cast("array<double>").alias("e")).where("e is not null")
    found = {}
    for dims, (n, sums) in column_sums(rows).items():
        seen = {"passes": 0, "trace": 0.0}

        def times(block, dims=dims, n=n, sums=sums, seen=seen):
            whole = summed(rows, dims, n, sums, lambda c: np.append((c.T @ (c @ block)).ravel(), (c * c).sum())) / n
            seen["passes"] += 1
            seen["trace"] = float(whole[-1])
            return whole[:-1].reshape(block.shape)

        components, values = top_pairs(times, dims, want, guard, degree, rounds, seed)
        over, width = components / np.sqrt(values), len(values)
        error = 0.0
        if width:
            spread = summed(rows, dims, n, sums, lambda c: ((c @ over).T @ (c @ over)).ravel()).reshape(width, width) / n
            error = float(np.abs(spread - np.eye(width)).max())
        found[dims] = Whitening(n, sums, components, values, seen["trace"], error, seen["passes"] + 2)
    return found


def whiten(vectors: DataFrame, fitted: dict, column: str = "embedding", out: str = "whitening") -> DataFrame:
    """``vectors`` and a struct ``out``: n, deviation, whitened and explained (one entry for each component), identity_error.

    The struct is null where a vector is null or empty, holds a null or an entry that
    is not finite, or one of 2**46 and more, whose whole number a double cannot hold
    exactly.  Vectors of each length are a space of their own, fitted and whitened by
    themselves.  Components without variance (all vectors equal, fewer vectors than
    components) are left out.  ``deviation`` is null where a long cannot hold it.  A
    column of the name ``out`` is replaced, all others pass through; repeated rows
    count and come back as often as they occur; an empty table stays empty.
    """
    kind = vectors.schema[column].dataType
    numeric = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    if not numeric:
        raise TypeError(f"{column} must be an array of floats or doubles")
    ready = {d: (f, f.vectors / np.sqrt(f.values), (f.values / f.trace).tolist()) for d, f in fitted.items() if len(f.values)}

    def prepare():
        def work(rows):
            made = [None] * len(rows)
            for dims, (at, x) in entries(pa.array(rows, pa.list_(pa.float64()))).items():
                if dims in ready:
                    f, over, explained = ready[dims]
                    far = from_mean(x, f.n, f.sums)
                    for k, deviation, w in zip(at.tolist(), squares(far), (far.astype(np.float64) / f.n @ over).tolist()):
                        made[k] = {"n": f.n, "deviation": deviation, "whitened": w, "explained": explained, "identity_error": f.identity_error}
            return made

        return work

    return append_struct(vectors, column, out, WHITENED, prepare)
