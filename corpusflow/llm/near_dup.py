"""Operator 3: near-duplicate documents by a chosen-path set similarity join.

A document is its set of five-word shingles; equal sets form one class, and only
class representatives go on.  In each of several independent trees a node picks
one or two places of the minwise signature (1 / threshold in the mean), and each
member goes to the child named by its minwise token there, so that a pair at the
threshold meets in a critical branching process.  Nodes of up to ``small`` members
are compared exhaustively on their signatures; larger ones branch further.

A critical process dies out with depth, so members of nodes that branch on start
further trees from the roots, as many as keep the share of missed pairs as small at
the new depth.  Nodes of up to ``most`` members, and all at the last
depth, are compared exhaustively too, a stripe of a node at a time.

Groups are what is asked for, so pairs inside one group need no second look.  An
opening round deals the nodes of two trees into parts of bounded size and takes each
member's nearest mates there; big groups of copies have joined after it.  Nodes
inside one group go, and a node of one big group and few others only compares those
others with it.  The last round takes every pair between different groups.  Each
candidate is confirmed on the full sets before it counts.
"""

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .components import components, contracted, named

PLACES = 96
FEW = 512
PRIME = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
THIRD = np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 1_000_000:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * PRIME
    return x ^ (x >> np.uint64(29))


def shingles(text, words: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle, one without words none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(size, len(codes))
    rolled = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * PRIME + mixed(codes[k : k + len(rolled)])
    return np.unique(mixed(rolled))


def signature(grams: np.ndarray, seeds: np.ndarray) -> bytes:
    """16 bits of the minwise token at each place."""
    best = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096, None] * seeds[None, :]
        best = np.minimum(best, (part ^ (part >> np.uint64(32))).min(0))
    return (mixed(best) >> np.uint64(48)).astype("<u2").tobytes()


def place_seeds(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def class_of(grams: np.ndarray) -> tuple:
    """The key of a shingle set (128 bits, None of an empty one) and its first 64 bits, by which classes are numbered.

    Two of a thousand million different sets share a number with a chance of 1 in 37.
    """
    key = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None
    return key, int.from_bytes(key[:8], "little", signed=True) if key else None


def sketches(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key, id (both null without shingles), sig."""

    def sketch(batches):
        words, seeds = WordHashes(), place_seeds(seed)
        for batch in batches:
            out = ([], [], [], [])
            for text in batch.column(2).to_pylist():
                grams = shingles(text, words, size)
                for column, value in zip(out, (len(grams), *class_of(grams), signature(grams, seeds) if len(grams) else None)):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "text_key", "n_shingles", "set_key", "id", "sig"]
            )

    schema = "doc_id long, text_key long, n_shingles long, set_key binary, id long, sig binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(sketch, schema)


def matrix(column) -> np.ndarray:
    """Signatures of a batch as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, PLACES)


def descend(node: np.ndarray, row: np.ndarray, sig: np.ndarray, levels: int, extra: float) -> tuple:
    """The nodes that each member reaches ``levels`` further down, and the member's row of each."""
    for _ in range(levels):
        more = (mixed(node ^ THIRD) >> np.uint64(11)).astype(np.float64) / (1 << 53) < extra
        picks = [(node, row, OTHER)]
        if more.any():
            picks.append((node[more], row[more], THIRD))
        kids, rows = [], []
        for at, r, salt in picks:
            place = mixed(at * salt + np.uint64(1)) % np.uint64(PLACES)
            token = sig[r, place.astype(np.int64)].astype(np.uint64)
            kids.append(mixed((at ^ salt) * PRIME + token * OTHER + place))
            rows.append(r)
        node, row = np.concatenate(kids), np.concatenate(rows)
    return node, row


def trees_for(depth: int, percent: int, miss: float) -> int:
    """How many trees leave at most the share ``miss`` of the pairs at the threshold without a common node at this depth.

    A pair at the threshold agrees in a binomial number of the places, and all trees
    see the same places, so the shares missed are averaged over that number.
    """
    t, extra = percent / 100, max(0.0, 100 / percent - 1)
    agree = np.arange(PLACES + 1)
    weight = np.array([math.comb(PLACES, k) * t**k * (1 - t) ** (PLACES - k) for k in agree.tolist()])
    meets = np.ones(PLACES + 1)
    for _ in range(depth):
        met = agree / PLACES * meets
        meets = 1 - (1 - extra) * (1 - met) - extra * (1 - met) ** 2
    trees = 1
    while float((weight * (1 - meets) ** trees).sum()) > miss:
        trees += 1
    return trees


def branch(members: DataFrame, levels: int, extra: float, trees: range | None = None, seed: int = 0) -> DataFrame:
    """(node, id, comp) of the children; from the roots of the numbered ``trees`` if given, else from the column node."""

    def run(batches):
        for batch in batches:
            sig, ids, comp = matrix(batch.column("sig")), batch.column("id").to_numpy(), batch.column("comp").to_numpy()
            if trees:
                roots = mixed(np.array(trees, dtype=np.uint64) * PRIME + np.uint64(seed))
                node, row = np.repeat(roots, len(ids)), np.tile(np.arange(len(ids)), len(roots))
            else:
                node, row = batch.column("node").to_numpy().view(np.uint64), np.arange(len(ids))
            node, row = descend(node, row, sig, levels, extra)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[row]), pa.array(comp[row])], ["node", "id", "comp"])

    return members.mapInArrow(run, "node long, id long, comp long")


def runs_of(batches, longest: int = 1 << 16):
    """Batches joined so that rows of one node, which stand together, come in one piece."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < longest // 2:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        node = table.column("node").to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def nearest(node: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, top: int | None) -> tuple:
    """Pairs (i, j) of rows of one node and their score ``s``: with ``top`` each row's so many nearest mates and its node's hub."""
    if not top:
        return i, j, s, np.zeros(len(i), dtype=bool)
    total = np.bincount(i, s, len(node)) + np.bincount(j, s, len(node))
    a, b, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
    order = np.lexsort((b, -w, a))
    a, b, w = a[order], b[order], w[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1))
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate((first, [len(a)]))))
    hub = b == np.lexsort((-total, node))[np.searchsorted(node, node)][a]
    keep = (place < top) | hub
    return a[keep], b[keep], w[keep], hub[keep]


def overlap(x: list, y: list) -> np.ndarray:
    """How many values each of the sorted arrays ``x`` has in common with each of ``y``, by products of incidence matrices."""
    every = x + y
    values, at, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(v) for v in every])
    number = np.cumsum(times > 1) - 1  # values of one array alone meet nothing
    keep = times[at] > 1
    row, at = row[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at, out = row[order], at[order], np.zeros((len(x), len(y)), dtype=np.float32)
    for start in range(0, int((times > 1).sum()), 8192):
        a, b = np.searchsorted(at, [start, start + 8192])
        held = np.zeros((len(every), 8192), dtype=np.float32)
        held[row[a:b], at[a:b] - start] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def within(x: list, y: list) -> np.ndarray:
    """How many values of each of ``x`` are not over the last of each of ``y``."""
    ends = np.array([v[-1] for v in y])
    return np.array([np.searchsorted(v, ends, side="right") for v in x])


def stripes(side: np.ndarray, first: int, width: int = 256) -> list:
    """What to compare of a node whose rows begin at ``first``: (rows, rows, whether a pair counts in one order only), ``width`` rows at a time against all they may meet."""
    at = first + np.arange(len(side))
    if (side == 0).any():
        return [(at[k : k + width], at[k:], True) for k in range(0, len(at), width)]
    x, y = at[side == 1], at[side == 2]
    return [(x[k : k + width], y, False) for k in range(0, len(x), width) if len(y)]


def compare_sets(members: DataFrame, percent: int, top: int | None) -> DataFrame:
    """As ``compare_nodes``, on the smallest shingles themselves (node, side, id, n, comp, few).

    A node stays in one task, which holds a stripe of its pairs at a time, so no row is copied.
    In a crowd of texts a little below the threshold signatures would let too many
    pairs pass.  ``few`` holds the smallest ``FEW`` shingles; of smaller sets that is
    all, so only pairs at the threshold pass.
    """

    def run(batches):
        for table in runs_of(batches, 1 << 13):
            node, side, ids, n, comp = (table.column(c).to_numpy() for c in ("node", "side", "id", "n", "comp"))
            few = [np.frombuffer(x, dtype="<u4") for x in table.column("few").to_pylist()]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [len(node)]))
            left, right, same = [], [], []

            def told():
                i, j, s, hub = nearest(node, np.concatenate(left), np.concatenate(right), np.concatenate(same), top)
                return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s.astype(np.int32)), pa.array(hub)], ["a", "b", "same", "hub"])

            for x, y, once in (t for a, b in zip(starts[:-1], starts[1:]) for t in stripes(side[a:b], a)):
                few_x, few_y, n_x, n_y = [few[k] for k in x], [few[k] for k in y], n[x][:, None], n[y][None, :]
                common, whole = overlap(few_x, few_y), (n_x <= FEW) & (n_y <= FEW)
                # of larger sets both are cut where the smallest values of one of them end
                seen = np.where(whole, n_x, within(few_x, few_y)) + np.where(whole, n_y, within(few_y, few_x).T)
                union = seen - common
                slack = np.where(whole, 1.0, 4.2 * np.sqrt(union * percent / 100 * (1 - percent / 100)))
                fits = (100 * (common + slack) >= percent * union) & (100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y))
                fits &= (comp[x][:, None] != comp[y][None, :]) & (x[:, None] < y[None, :] if once else True)
                i, j = np.nonzero(fits)
                left.append(x[i])
                right.append(y[j])
                same.append((1000 * common[i, j] / union[i, j]).astype(np.int64))
                if sum(map(len, left)) > 1 << 20:
                    yield told()
                    left, right, same = [], [], []
            if sum(map(len, left)):
                yield told()

    return members.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long, same int, hub boolean")


def compare_nodes(members: DataFrame, least: int, percent: int, top: int | None) -> DataFrame:
    """Candidate pairs (a, b, same, hub) among the rows of each node (node, side, id, n, sig, comp).

    Compared are rows of different groups that can reach the threshold, unless both
    have one ``side`` other than 0.  ``same`` is how many places agree.  With ``top``
    each member keeps only that many nearest mates, and the node's hub, which is the
    member nearest to all others.
    """

    def run(batches):
        for table in runs_of(batches):
            node, side, ids, n, comp = (table.column(c).to_numpy() for c in ("node", "side", "id", "n", "comp"))
            sig = matrix(table.column("sig").combine_chunks())
            left, right, same = [], [], []
            for d in range(1, len(node)):
                i = np.flatnonzero(node[:-d] == node[d:])
                if not len(i):
                    break
                j = i + d
                fits = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] != side[j]) | (side[i] == 0))
                i, j = i[fits], j[fits]
                equal = np.concatenate([(sig[i[k : k + 8192]] == sig[j[k : k + 8192]]).sum(1) for k in range(0, len(i), 8192)] or [np.zeros(0, np.int64)])
                near = equal >= least
                left.append(i[near])
                right.append(j[near])
                same.append(equal[near])
            if not left or not sum(map(len, left)):
                continue
            i, j, s = np.concatenate(left), np.concatenate(right), np.concatenate(same)
            i, j, s, hub = nearest(node, i, j, s, top)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s.astype(np.int32)), pa.array(hub)], ["a", "b", "same", "hub"])

    return members.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long, same int, hub boolean")


def pairs_of(found: DataFrame, top: int | None) -> DataFrame:
    """Distinct pairs (a, b), a < b; with ``top`` of each member over all its nodes so many nearest mates and one hub."""
    if top:
        best = Window.partitionBy("a", "hub").orderBy(F.desc("same"), "b")
        each = found.groupBy("a", "b").agg(F.max("same").alias("same"), F.max("hub").alias("hub")).withColumn("place", F.row_number().over(best))
        found = each.where(f"place <= {top} and (not hub or place = 1)")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dealt(nodes: DataFrame, part: int) -> DataFrame:
    """Nodes (node, id, count) in parts of about ``part`` members, each dealt in its own way."""
    at = F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("count") / part).cast("long"))
    return nodes.select(F.when(F.col("count") > part, F.xxhash64("node", at)).otherwise(F.col("node")).alias("node"), F.lit(0).alias("side"), "id")


def few_against_one(nodes: DataFrame, part: int) -> DataFrame:
    """Nodes (node, id, comp, count, big) of one big group and few others: the others go to every part of the group."""
    parts = F.ceil(F.col("count") / part).cast("long")
    lone = F.col("comp") != F.col("big")
    own = F.pmod(F.xxhash64("node", "id"), parts)
    spread = nodes.withColumn("part", F.explode(F.when(lone, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))))
    side = F.when(F.col("part") == 0, 0).when(lone, 1).otherwise(2)
    return spread.select(F.xxhash64("node", "part").alias("node"), side.alias("side"), "id")


def blocks(nodes: DataFrame, part: int) -> DataFrame:
    """All pairs of a node (node, id, count) in blocks: each part meets every part of its node, itself included."""
    parts = F.ceil(F.col("count") / part).cast("long")
    spread = nodes.withColumn("p", F.pmod(F.xxhash64("node", "id"), parts)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    side = F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2)
    return spread.select(F.xxhash64("node", F.least("p", "q"), F.greatest("p", "q")).alias("node"), side.alias("side"), "id")


def marked(ids: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """Bits in which every doc_id sets the one at its hash: about 16 for an id, never more than ``most_bits`` (8 MB)."""
    bits = min(most_bits, max(1 << 15, 1 << (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("held"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.collect():  # at most 2048 rows of 4 KB, and one job instead of one for each partition
        out[(row["part"] - 1) * 4096 :][:4096] = np.frombuffer(row["held"], np.uint8)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, grams, few): the shingle sets, and the upper halves of their smallest ``FEW``, of the classes ``wanted`` (id, doc_id of one of its documents).

    Texts are sifted where they are read, by a bitmap of bounded size that holds
    every doc_id asked for; the join then drops what passed by chance.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(marked(wanted))

    def sets(batches):
        words, held = WordHashes(), shipped.value
        for batch in batches:
            at = batch.column(1).to_numpy() % (8 * len(held))  # of the divisor's sign, as pmod
            batch = batch.filter(pa.array((held[at >> 3] >> (at & 7)) & 1 == 1))
            made = [shingles(t, words, size) for t in batch.column(0).to_pylist()]
            few = [(x[:FEW] >> np.uint64(32)).astype("<u4").tobytes() for x in made]
            columns = ([class_of(x)[1] for x in made], [x.tobytes() for x in made], few)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["id", "grams", "few"])

    texts = docs.where("doc_id is not null").select("text", F.xxhash64(F.col("doc_id").cast("long")).alias("at"))
    made = texts.mapInArrow(sets, "id long, grams binary, few binary")
    return made.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full shingle sets, as edges (u, v)."""

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = 0
                if len(x) and len(y):
                    x, y = (x, y) if len(x) < len(y) else (y, x)
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            ok = np.array(ok, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in ("a", "b")], ["u", "v"])

    x = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 85, size: int = 5, small: int = 64, part: int = 256, most: int = 4096, depth: int = 4, step: int = 8, deepest: int = 20, miss: float = 0.001, deep_miss: float = 0.01, seed: int = 3
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, group_key: one row for each row of ``docs``.

    ``text_key`` is the xxhash64 of the row's text, ``group_key`` the number of its
    group (null where it links with nothing at all).    There are so many trees that a
    pair at the threshold has no common node with probability ``miss`` at the first
    depth and ``deep_miss`` below it, where only large nodes lead; pairs over it are
    missed less.  Nodes of more than ``most`` members branch on down to ``deepest``.
    Rows that share a doc_id are each judged by their own text.  A null
    doc_id, like a text that is null, empty or without words, links with nothing: its
    component is its own doc_id and it is kept.  An empty table gives an empty result.
    Only doc_id and text are read, so other columns may have any name.
    """
    spread = 4.2 * np.sqrt(percent / 100 * (1 - percent / 100) / PLACES)
    least, extra = int(PLACES * max(0.0, percent / 100 - spread)), max(0.0, 100 / percent - 1)
    drawn = materialize(sketches(docs, size, seed), "sketches")
    linkable = drawn.where("id is not null and doc_id is not null")
    classes = linkable.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    reps = classes.select("id", "n", "sig")
    groups, tried, sets, links, spent = reps.select("id", F.col("id").alias("comp")), None, None, None, [classes]

    def written(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialize(df, name))
        return spent[-1]

    def read(ids: DataFrame) -> None:
        """See that the sets of these classes are there."""
        nonlocal sets
        ids = ids.distinct() if sets is None else ids.distinct().join(sets.select("id"), "id", "left_anti")
        wanted = written(classes.select("id", "doc_id").join(ids, "id"), "wanted")
        if not wanted.isEmpty():
            made = written(full_sets(docs, wanted, size), "sets")
            sets = made if sets is None else sets.union(made)

    def take(found: DataFrame) -> bool:
        """Confirm the pairs that were not tried before and join their groups; false without such pairs.

        These groups only save work, so a few steps of the search for components will do.
        The next call goes on from the edges they leave, which connect the same classes.
        """
        nonlocal groups, tried, links
        new = written(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            return False
        tried = new if tried is None else tried.union(new)
        read(new.select(F.explode(F.array("a", "b")).alias("id")))
        linked = written(confirm(new, sets, percent), "links")
        links = contracted(linked if links is None else links.union(linked), steps=2)
        spent.append(links)
        names = named(links).withColumnRenamed("component", "comp")
        groups = written(reps.select("id").join(names, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "groups")
        return True

    def compared(nodes: DataFrame, top: int | None, sharp: bool = False) -> DataFrame:
        """Pairs between the groups of ``nodes`` (node, side, id)."""
        marks = nodes.withColumn("comp", F.col("id")) if tried is None else nodes.join(groups, "id")
        if tried is not None:
            split = marks.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
            marks = marks.join(split.select("node"), "node", "left_semi")
        marks = marks.join(reps, "id")
        if sharp:
            return compare_sets(marks.select("node", "side", "id", "n", "comp").join(sets.select("id", "few"), "id"), percent, top)
        return compare_nodes(marks.select("node", "side", "id", "n", "sig", "comp"), least, percent, top)

    def open_nodes(front: DataFrame) -> DataFrame:
        """The rows of nodes that hold several groups, with the node's size."""
        sizes = front.groupBy("node").agg(F.count("*").alias("count"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        return written(front.join(sizes.select("node", "count"), "node"), "nodes")

    at, trees, held, crowded = depth, trees_for(depth, percent, miss), [], []
    opening = open_nodes(branch(reps.withColumn("comp", F.col("id")), depth, extra, range(1, 3), seed))
    take(pairs_of(compared(dealt(opening, small), 2), 2))
    front = branch(reps.join(groups, "id"), depth, extra, range(1, trees + 1), seed)
    while True:
        whole = open_nodes(written(front, "front"))
        held.append(whole.where(F.col("count") <= small).select("node", F.lit(0).alias("side"), "id"))
        large = whole.where(F.col("count") > small)
        if large.isEmpty():
            break
        tops = large.groupBy("node", "comp").count().groupBy("node").agg(F.max(F.struct("count", "comp")).alias("top"))
        shaped = written(large.join(tops.select("node", F.col("top.comp").alias("big"), F.col("top.count").alias("of_big")), "node"), "large")
        few = F.col("count") - F.col("of_big") <= small
        crowded.append(few_against_one(shaped.where(few), part))
        heavy = shaped.where(~few)
        further = heavy.where(F.col("count") > most) if at < deepest else heavy.limit(0)
        # no row of a node of up to ``most`` members has copies; larger ones, at the last depth, are dealt in blocks of that size
        crowded.append(blocks(heavy.where(F.col("count") <= most) if at < deepest else heavy, most))
        read(shaped.select("id") if at >= deepest else shaped.where(few | (F.col("count") <= most)).select("id"))
        if further.isEmpty():
            break
        take(pairs_of(compared(dealt(further, small), 2), 2))
        at, before = at + step, trees
        trees = max(before, trees_for(at, percent, deep_miss))
        members = further.select("node", "id").join(reps, "id").join(groups, "id")
        front = branch(members, step, extra)
        if trees > before:
            front = front.union(branch(members.dropDuplicates(["id"]), at, extra, range(before + 1, trees + 1), seed))

    crowd = written(reduce(DataFrame.union, crowded), "crowd") if crowded and sets is not None else None
    for top in (3, None):
        found = compared(reduce(DataFrame.union, held), top)
        if crowd is not None:  # a table of its own, as its nodes are so much larger than the others
            found = found.union(written(compared(crowd, top, True), "of-crowd"))
        if not take(pairs_of(found, top)):
            break  # no two groups meet anywhere

    owners = classes.select("id", "doc_id")
    found = components(links) if links is not None else owners.select("id", F.col("id").alias("component")).limit(0)
    owners = owners.join(found, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("group_key"))
    smallest = owners.groupBy("group_key").agg(F.min("doc_id").alias("component"))
    owned = materialize(owners.join(smallest, "group_key").select("id", "component", "group_key"), "components")
    for t in spent:
        drop_table(t)
    joined = drawn.join(owned, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept, "text_key", F.when(F.col("doc_id").isNotNull(), F.col("group_key")).alias("group_key"))
