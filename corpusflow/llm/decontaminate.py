"""Operator 8: removal spans of benchmark text, found through an FM-index of each training shard.

Benchmark items are cut into windows of consecutive words.  Each task indexes its
documents shard by shard: the words of a shard become numbers, its suffixes are
sorted, and the Burrows-Wheeler transform is kept in a wavelet matrix.  All
windows are searched backwards at once; the rows found are located through
sampled suffix positions, and the spans of one document are merged.

Words that no window holds can be part of no occurrence.  They and runs of words
shorter than the shortest window are left out of the index, which loses nothing.
"""

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

NOT_WORD = bytes(32 if not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else b for b in range(256))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
FOUND_ARROW = to_arrow_type(FOUND)


def words_of(text) -> list:
    """Words of letters and digits, A-Z lower-cased; characters beyond ASCII belong to words."""
    return text.encode("utf-8", "surrogatepass").lower().translate(NOT_WORD).split() if text else []


class Windows:
    """The distinct windows of a block of benchmark items, as word numbers from 1."""

    def __init__(self, items: list, size: int):
        self.vocabulary: dict = {}
        found: dict = {}
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for k in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[k : k + size]), set()).add(str(item_id))
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        self.words = np.zeros((len(found), size), dtype=np.int64)  # filled from the right
        for k, w in enumerate(found):
            self.words[k, size - len(w) :] = w
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.lengths.min()) if len(found) else 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is an end mark of its own, ordered by place."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max()) + 1) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            counts = np.concatenate(([0], np.cumsum(ones)))
            zeros = len(values) - int(counts[-1])
            self.levels.append((bit, counts, zeros))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start, end = np.zeros_like(place), place
        for bit, counts, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            start = np.where(one, zeros + counts[start], start - counts[start])
            end = np.where(one, zeros + counts[end], end - counts[end])
        return end - start

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for bit, counts, zeros in self.levels:
            one = counts[place + 1] - counts[place]
            symbol |= one << bit
            place = np.where(one == 1, zeros + counts[place], place - counts[place])
        return symbol


class FMIndex:
    """Of a sequence of word numbers in which 0 ends each run; it must end with 0."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        top = int(symbols.max())
        before = symbols[order - 1]
        self.tree = WaveletMatrix(before, top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 2))))
        sampled = (order % self.SAMPLE == 0) | (before == 0)
        self.position = np.where(sampled, order, -1)
        self.size, self.top = len(symbols), top

    def search(self, windows: Windows) -> tuple:
        """The range of rows of each window."""
        size = windows.words.shape[1]
        low = np.zeros(len(windows.words), dtype=np.int64)
        high = np.full(len(windows.words), self.size, dtype=np.int64)
        for k in range(size - 1, -1, -1):
            word = windows.words[:, k]
            live = np.flatnonzero((word > 0) & (low < high))
            if not len(live):
                continue
            w = word[live]
            inside = w <= self.top
            w = np.where(inside, w, 0)
            new_low = self.first[w] + self.tree.rank(w, low[live])
            new_high = self.first[w] + self.tree.rank(w, high[live])
            low[live], high[live] = new_low, np.where(inside, new_high, new_low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: back through the text to a sampled position."""
        found = self.position[rows]
        steps = np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(found < 0)
        at = rows[open_]
        while len(open_):
            word = self.tree.access(at)
            at = self.first[word] + self.tree.rank(word, at)
            steps[open_] += 1
            hit = self.position[at] >= 0
            found[open_[hit]] = self.position[at[hit]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
        return found


def occurrences(words: np.ndarray, windows: Windows) -> tuple:
    """All (window, first word) of a shard; ``words`` has 0 for a foreign word and after each document."""
    none = np.zeros(0, dtype=np.int64)
    known = np.concatenate(([0], (words > 0).astype(np.int8), [0]))
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= windows.shortest
    start, end = start[long], end[long]
    if not len(start) or not windows.shortest:
        return none, none
    size = end - start + 1  # each run and its end mark
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.repeat(start - base, size) + np.arange(size.sum())
    runs = words[np.minimum(place, len(words) - 1)].astype(np.int64)
    runs[base + size - 1] = 0
    index = FMIndex(runs)
    low, high = index.search(windows)
    count = high - low
    hit = np.flatnonzero(count > 0)
    if not len(hit):
        return none, none
    count = count[hit]
    rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    return np.repeat(hit, count), place[index.locate(rows)]


def merge(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def found_in(texts: list, windows: Windows, earlier: list) -> list:
    """The result for each text of one shard, joined with that of earlier benchmark blocks."""
    lookup, parts, sizes = windows.vocabulary.get, [], []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(lookup, words, repeat(0)), dtype=np.int32, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int32))
        sizes.append(len(words))
    shard = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    begin = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)))
    which, at = occurrences(shard, windows)
    doc = np.searchsorted(begin, at, side="right") - 1
    spans: dict = {}
    items: dict = {}
    for d, w, a in zip(doc.tolist(), which.tolist(), (at - begin[doc]).tolist()):
        spans.setdefault(d, []).append((a, a + int(windows.lengths[w])))
        items.setdefault(d, set()).update(windows.items[w])
    out = []
    for d, n in enumerate(sizes):
        own, names = spans.get(d, []), items.get(d, set())
        if earlier[d]:
            own, names = own + [tuple(s) for s in earlier[d]["spans"]], names | set(earlier[d]["items"])
        own, names = merge(own), sorted(names)
        hit = sum(b - a for a, b in own)
        out.append(
            {
                "n_words": n, "n_hit": hit, "n_items": len(names), "contaminated": hit > 0, "spans": own, "items": names,
                "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
            }
        )
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, out: str = "found", text: str = "text",
    block_words: int = 2_000_000, shard_chars: int = 12_000_000,
) -> DataFrame:
    """``docs`` and one struct column ``out``: n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    ``spans`` are merged [first word, end word) pairs, ``items`` the ids of items
    with an occurring window.  A null or empty text has no words and is clean; an
    item without words has no window; repeated rows get equal results.  A column
    of the name ``out`` is replaced.  The benchmark goes to the executors in
    blocks of at most ``block_words`` words (and one item), each a pass over the
    rows in the same stage, so that no broadcast exceeds that size.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != out]
    result = docs.select(*(F.col(f"`{c}`") for c in kept))
    blocks, block, words = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words_of(row[1]))
        if block and words + n > block_words:
            blocks.append(block)
            block, words = [], 0
        block.append((row[0], row[1]))
        words += n
    blocks.append(block)
    for k, items in enumerate(blocks):
        shipped = spark.sparkContext.broadcast(Windows(items, size))

        def search(batches, shipped=shipped, later=k > 0):
            windows = shipped.value

            def flush(held):
                table = pa.Table.from_batches(held)
                earlier = table.column(out).to_pylist() if later else [None] * len(table)
                rows = found_in(table.column(text).to_pylist(), windows, earlier)
                columns = [table.column(c) for c in kept] + [pa.array(rows, FOUND_ARROW)]
                yield from pa.table(columns, [*kept, out]).to_batches(max_chunksize=2000)

            held, chars = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    held.append(part)
                    chars += part.column(text).nbytes
                    if chars >= shard_chars:
                        yield from flush(held)
                        held, chars = [], 0
            if held:
                yield from flush(held)

        schema = T.StructType([f for f in result.schema.fields if f.name != out] + [T.StructField(out, FOUND)])
        result = result.mapInArrow(search, schema)
    return result
