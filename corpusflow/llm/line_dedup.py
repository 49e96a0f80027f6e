"""Operator 2: removing repeated passages of several lines, wherever they start.

A text is cut into lines, a line of several sentences into its sentences, and a
sentence of many words where the hash of two neighbouring words is the smallest of
several; all of these count as lines here.  Nothing but the words around a cut
decides it.  At every line a run starts that is just long enough to be looked up,
so a passage that moves to another place has the same runs there, whatever stands
before it.  Of these runs a sift keeps at least one in every passage of ``span``
words.  Runs that occur more than once in the corpus are compared byte for byte, but
for the white space that ends a line, with their first occurrence (smallest doc_id,
then first in the text), and the match is extended over the lines around it as far as they agree.  All but the first
occurrence are removed.  Runs and cuts count words between ASCII white space.
"""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, materialize

NO_ID = -(1 << 62)
BLOCK = 1 << 18
ROWS = 500  # of how many a batch of new texts is
STRETCH = 32  # how many lines of a passage are compared at once, those around them beside
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
BYTES = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The last bytes of the white space that ``str.rstrip`` takes beside tab to carriage return and the blank.
LAST = np.isin(np.arange(256), [*range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * BASE
    return (x ^ (x >> np.uint64(29))) * OTHER


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, 1 << 10), powers(INVERSE, 1 << 10)


def grown(count: int) -> tuple:
    """Powers of ``BASE`` and of its inverse, ``count`` at least; those of a block are kept for the next one."""
    global UP, DOWN
    if count <= len(UP):
        return UP, DOWN
    up, down = powers(BASE, 2 * count), powers(INVERSE, 2 * count)
    if count <= 4 * BLOCK:
        UP, DOWN = up, down
    return up, down


def codes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each of the ranges [a, b), none of them empty, in their order."""
    out, k = np.zeros(len(a), dtype=np.uint64), 0
    while k < len(a):
        n = max(k + 1, int(np.searchsorted(b, a[k] + BLOCK, side="right")))
        low, high = int(a[k]), int(b[n - 1])
        up, down = grown(high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(BYTES[data[low:high]] * up[: high - low], out=total[1:])
        out[k:n] = (total[b[k:n] - low] - total[a[k:n] - low]) * down[a[k:n] - low]
        k = n
    return mixed(out)


def sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``values`` in each of the ranges [a, b), which may overlap or be empty."""
    up, down = grown(len(values) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def inner_cuts(sentence: np.ndarray, at: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """Which of the words ``at`` begin the smallest pair of any ``window`` pairs of their sentence: it is cut before them.

    ``words`` are their hashes.  Where two pairs are equally small there is no cut, so
    a line that repeats itself in a short period stays whole.
    """
    if len(at) <= window:
        return at[:0]
    own, place = sentence[at], np.arange(len(at) - 1, dtype=np.uint64)
    pair = mixed(words[:-1] * OTHER ^ words[1:]) & np.uint64(0xFFFFFFFF00000000)
    low = np.uint64(0xFFFFFFFF)
    left, right = (least_of(x, window) & low for x in (pair | place, pair | (low - place)))
    ok = (left == low - right) & (own[: len(left)] == own[window:])
    cut = left[ok].astype(np.int64)  # in order, as the smallest of a later window is no earlier one
    cut = cut[np.concatenate((cut[:1] >= 0, cut[1:] != cut[:-1]))]
    return at[cut[(cut > 0) & (own[cut] == own[cut - 1])]]


class Lines:
    """The lines of several texts in UTF-8: where each starts and ends, how many words it has, its hash if asked for, and each text's first line."""

    def __init__(self, texts: list, hashed: bool = True, most: int = 24, window: int = 12):
        self.raw = texts
        self.data = data = np.frombuffer(b"\n".join([*self.raw, b""]), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in self.raw])))
        blank = data == 32
        space = (data - np.uint8(9) < 5) | blank
        edges = np.flatnonzero(np.concatenate(([~space[0]], space[1:] != space[:-1])))
        begin, end = edges[::2], edges[1::2]
        opens = np.concatenate(([True], data[:-1] == 10))
        opens[2:] |= (data[:-2] == 46) & blank[1:-1]
        starts = np.flatnonzero(opens)
        counts = np.diff(np.searchsorted(begin, np.concatenate((starts, [len(data)]))))
        sentence = np.repeat(np.arange(len(starts)), counts)
        at = np.flatnonzero(np.repeat(counts > most, counts))
        words = codes(data, begin, end) if hashed else None
        cuts = inner_cuts(sentence, at, words[at] if hashed else codes(data, begin[at], end[at]), window)
        starts = np.sort(np.concatenate((starts, begin[cuts])))
        ends = np.concatenate((starts[1:], [len(data)]))
        last = self.offsets[1:] - 1  # the line feed that was put behind each text is no part of it
        text = np.searchsorted(self.offsets, starts, side="right") - 1
        real = starts < last[text]
        self.starts, self.ends = starts[real], np.minimum(ends, last[text])[real]
        self.firsts = np.searchsorted(self.starts, self.offsets)
        self.text = text[real]

        self.word_ends = end
        self.word_at = word_at = np.searchsorted(begin, np.concatenate((self.starts, [len(data)])))
        self.words = np.diff(word_at)
        self.before = np.concatenate(([0], np.cumsum(self.words)))
        if not hashed:
            return
        line = np.repeat(np.arange(len(self.starts)), self.words)
        gap = np.maximum(self.starts[line], np.concatenate(([0], end[:-1]))) if len(begin) else begin
        width = begin - gap
        before = np.where(width > 0, data[np.minimum(gap, len(data) - 1)], 0).astype(np.uint64)
        wide = np.flatnonzero(width > 1)
        before[wide] = codes(data, gap[wide], begin[wide])
        self.hash = sums(mixed(words + before * OTHER), word_at[:-1], word_at[1:])

    def without(self, n: int, a: np.ndarray, b: np.ndarray) -> tuple:
        """The text ``n`` without its lines in the ranges [a, b), and how many lines these are."""
        low, high = self.firsts[n], self.firsts[n + 1]
        depth = np.bincount(a, minlength=high - low + 1) - np.bincount(b, minlength=high - low + 1)
        stays = np.concatenate(([False], np.cumsum(depth[:-1]) == 0, [False]))
        turns = np.flatnonzero(stays[1:] != stays[:-1])
        spans = zip((self.starts[low + turns[::2]] - self.offsets[n]).tolist(), (self.ends[low + turns[1::2] - 1] - self.offsets[n]).tolist())
        return b"".join([self.raw[n][x:y] for x, y in spans]), int(high - low - stays.sum())

    def of(self, n: int) -> list:
        """The lines of the text ``n``, each with what ends it."""
        low, high = self.firsts[n], self.firsts[n + 1]
        spans = zip((self.starts[low:high] - self.offsets[n]).tolist(), (self.ends[low:high] - self.offsets[n]).tolist())
        return [self.raw[n][a:b].decode("utf-8", "surrogatepass") for a, b in spans]

    def stripped(self) -> tuple:
        """All lines in one text, each without the white space that ends it and with a line feed, which no line holds elsewhere; and where each starts.

        White space stands before every line and a line feed behind every text, so
        there is a byte for the line feed.
        """
        ends = self.starts.copy()
        full = np.flatnonzero(self.words)
        ends[full] = self.word_ends[self.word_at[full + 1] - 1]
        for n in full[LAST[self.data[ends[full] - 1]]].tolist():
            a = self.starts[n]
            ends[n] = a + len(self.data[a : ends[n]].tobytes().decode("utf-8", "surrogatepass").rstrip().encode("utf-8", "surrogatepass"))
        data, turns = self.data.copy(), np.zeros(len(self.data) + 1, dtype=np.int8)
        data[ends] = 10
        turns[self.starts] = 1
        turns[ends + 1] -= 1
        text = data[np.cumsum(turns[:-1], dtype=np.int8).view(bool)].tobytes()
        return text, np.concatenate(([0], np.cumsum(ends + 1 - self.starts)))

    def runs(self, least: int, alone: int) -> tuple:
        """Ranges [first line, end line) of the shortest run at each line: two lines with ``least`` words, or one with ``alone``."""
        a = np.arange(len(self.starts))
        b = np.maximum(a + 2, np.searchsorted(self.before, self.before[:-1] + least))
        b = np.where(self.words >= alone, a + 1, b)
        ok = b <= self.firsts[self.text + 1]
        return a[ok], b[ok]

    def sifted(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray, span: int) -> np.ndarray:
        """Which of the runs [a, b) have the smallest key of all that end within ``span`` words of some run's start.

        They depend on nothing outside these words, so a passage of ``span`` words or
        more holds at least one of them in each of its copies.
        """
        n = np.arange(len(a))
        last = np.searchsorted(a, self.firsts[self.text[a] + 1])
        q = np.minimum(last, np.maximum(n + 1, np.searchsorted(self.before[b], self.before[a] + span, side="right")))
        bits = np.uint64(int(len(a)).bit_length())
        table = (keys >> bits << bits) | (np.uint64(len(a)) - n.astype(np.uint64))  # of equal keys the last
        level, best = np.frexp(q - n)[1] - 1, np.zeros(len(a), dtype=np.uint64)
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
            at = np.flatnonzero(level == k)
            best[at] = np.minimum(table[at], table[q[at] - (1 << k)])
        held = np.zeros(len(a), dtype=bool)
        held[len(a) - (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
        return np.flatnonzero(held)


def in_blocks(texts: pa.Array, hashed: bool = True):
    """(number of the first text, ``Lines`` of the texts) for texts of about ``BLOCK`` bytes together; null is empty."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        n = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK)) + 1
        yield first, Lines([t or b"" for t in texts[first:n].cast(pa.binary()).to_pylist()], hashed)
        first = n


def strings(text: bytes, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The ranges [a, b) of a text in UTF-8."""
    offsets = np.concatenate(([0], np.cumsum(b - a))).astype(np.int32)
    parts = b"".join([text[x:y] for x, y in zip(a.tolist(), b.tolist())])
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(parts))


def flat(marks: pa.Array) -> tuple:
    """Of a column of lists of structs where each row's list starts and ends, and the structs' fields by name; null is an empty list."""
    marks = pc.if_else(pc.is_null(marks), pa.scalar([], marks.type), marks) if marks.null_count else marks
    items = marks.flatten()
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(marks).to_numpy(zero_copy_only=False))))
    return bounds.astype(np.int64), {f.name: pc.struct_field(items, [f.name]) for f in items.type}


def units(text: str) -> list:
    """Lines, each with what ends it; a line ends at a line feed, after a sentence, or within one of many words."""
    return Lines([text.encode("utf-8", "surrogatepass")]).of(0)


def agree(x: list, y: list) -> int:
    """How many lines from the start are equal."""
    n = 0
    for a, b in zip(x, y):
        if a != b:
            break
        n += 1
    return n


def shared_words(x: list, y: list, n: int, step: int) -> int:
    """How many words the lines ``n`` have in common from their start (``step`` 1) or from their end (-1)."""
    if n >= len(x) or n >= len(y):
        return 0
    x, y = x[n].split()[::step], y[n].split()[::step]
    return next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def dedup_lines(docs: DataFrame, chunk_words: int = 10, least_words: int = 30, span: int = 24, reach: int = 4, copies: int = 256, text: str = "text", out: str = "n_removed") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and a column ``out``: how many lines went.

    Runs are two lines or more with ``chunk_words`` words, or one with
    ``least_words``; in any ``span`` words of whole lines that hold one, one is looked
    up.  A repeat is removed if it has ``least_words`` words with
    the lines around it that agree; of lines that agree in part the words count, but
    stay.  ``reach`` lines on either side are compared, and more until they have
    ``least_words`` words.
    Rows are told apart by (doc_id, text): rows equal in both are one document here
    and keep what one of them would; a null doc_id comes last.  Null and empty texts
    stay as they are, and ``out`` is 0.  Runs are first counted by a 64-bit hash
    (of a million million different runs some 30000 share theirs with another one, and
    a repeat of the later one of two that do stays);
    those that touch and repeat at the same distance from their first occurrences
    are one passage, of which every ``STRETCH`` lines are compared once, with what is around
    them.  A run that agrees with its first occurrence in too few words is looked up
    again with the windows of ``least_words`` words around it, each of which has a first
    occurrence of its own: so a passage is found whose runs all occur elsewhere
    before.  Copies of one run go to the tasks in parts of about ``copies``.  A column of
    the name ``out`` is replaced.
    """

    def cut(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, lines in in_blocks(batch.column(2)):
                a, b = lines.runs(chunk_words, least_words)
                h = sums(lines.hash, a, b)
                held = lines.sifted(a, b, h, span)
                a, b, h = a[held], b[held], h[held]
                low, row = lines.firsts[lines.text[a]], at + lines.text[a]
                columns = (ids[row], keys[row], (a - low).astype(np.int32), (b - low).astype(np.int32), h.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i_", "k_", "first", "end_", "h"])

    def pick(batches):
        """Of the repeats of a text that touch, at one distance from their first occurrences: for each ``STRETCH`` lines the one of the smallest hash.

        ``up`` and ``down`` are how many lines the others reach beyond it, ``hashes`` those of all of them.
        """
        for batch in batches:
            bounds, marks = flat(batch.column("marks"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            if not len(row):
                continue
            first, end, h, i_0, k_0, f_0 = (marks[c].to_numpy() for c in ("first", "end_", "h", "i_0", "k_0", "f_0"))
            order = np.lexsort((end, first, first - f_0, k_0, i_0, row))
            row, first, end, h, i_0, k_0, f_0 = (x[order] for x in (row, first, end, h, i_0, k_0, f_0))
            parted = np.concatenate(([True], first[1:] > end[:-1]))
            for x in (row, i_0, k_0, first - f_0):
                parted[1:] |= x[1:] != x[:-1]
            stretch = (first - first[np.flatnonzero(parted)][np.cumsum(parted) - 1]) // STRETCH
            parted[1:] |= stretch[1:] != stretch[:-1]
            at = np.flatnonzero(parted)
            one = np.lexsort((h, np.cumsum(parted)))[at]
            up, down = first[one] - first[at], np.maximum.reduceat(end, at) - end[one]
            hashes = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)), pa.int32()), pa.array(h))
            own = [batch.column(c).take(pa.array(row[one])) for c in ("i_", "k_")]
            columns = [*own, *(marks[c].take(pa.array(order[one])) for c in ("first", "end_", "h", "parts")), pa.array(up), pa.array(down), hashes]
            yield pa.RecordBatch.from_arrays(columns, ["i_", "k_", "first", "end_", "h", "parts", "up", "down", "hashes"])

    kept = [c for c in docs.columns if c != out]
    names = [f"c{n}" for n in range(len(kept))]
    at_text = kept.index(text)
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)))
    number = F.coalesce(F.col(names[kept.index("doc_id")]).cast("long"), F.lit(NO_ID))
    keyed = plain.select(number.alias("i_"), F.xxhash64(names[at_text]).alias("k_"), F.struct(*names).alias("row_"))

    SPOT = "i_ long, k_ long, first int, end_ int, h long"
    place = F.struct(F.col("i_") == NO_ID, "i_", "k_", "first", "end_")

    def repeats(found: DataFrame) -> tuple:
        """Of runs at ``SPOT``s those whose hash occurs in two rows or more; and for each hash the first spot and into how many parts its copies are dealt."""
        repeated = found.groupBy("h").count().where("count > 1").select("h")
        repeated = materialize(repeated, "repeated")  # a table, so that the join can split a hot hash
        seen = materialize(found.join(repeated.hint("shuffle_hash"), "h", "left_semi"), "repeats")
        drop_table(repeated)
        parts = F.ceil(F.count("*") / copies).cast("int").alias("parts")
        return seen, materialize(seen.groupBy("h").agg(F.min(place).alias("least"), parts), "least")

    def passages(seen: DataFrame, least: DataFrame, name: str) -> DataFrame:
        """Of the runs ``seen`` those that are no first occurrence, one for each passage that they make up."""
        origin = (F.col("least.i_").alias("i_0"), F.col("least.k_").alias("k_0"), F.col("least.first").alias("f_0"))
        again = seen.join(least.hint("shuffle_hash"), "h").where(place != F.col("least")).select("i_", "k_", F.struct("first", "end_", "h", "parts", *origin).alias("at"))
        texts_again = again.groupBy("i_", "k_").agg(F.collect_set("at").alias("marks"))  # as many as the text has lines
        return materialize(texts_again.mapInArrow(pick, SPOT + ", parts int, up int, down int, hashes array<long>"), name)

    texts = keyed.select("i_", "k_", f"row_.{names[at_text]}")
    found = materialize(texts.mapInArrow(cut, SPOT), "chunks")
    seen, least = repeats(found)
    drop_table(found)
    picked = passages(seen, least, "picked")

    def marks_of(lines: Lines, at: int, bounds: np.ndarray, marks: dict) -> tuple:
        """Of the texts from the row ``at`` on: their marks, each mark's row, and the lines [a, b) that it marks and [low, high) of its text."""
        own = bounds[at : at + len(lines.raw) + 1]
        n, row = np.arange(own[0], own[-1]), np.repeat(np.arange(len(lines.raw)), np.diff(own))
        low, high = lines.firsts[row], lines.firsts[row + 1]
        a, b = (low + marks[c].to_numpy()[own[0] : own[-1]] for c in ("first", "end_"))
        return n, at + row, a, b, low, high

    def windows(batches):
        """The shortest windows of ``least_words`` words around each marked run, one for each line where they may end."""
        for batch in batches:
            ids, keys = batch.column("i_").to_numpy(), batch.column("k_").to_numpy()
            bounds, marks = flat(batch.column("marks"))
            for at, lines in in_blocks(batch.column("t_")):
                _, _, a, b, low, high = marks_of(lines, at, bounds, marks)
                far = np.minimum(high, np.maximum(b, np.searchsorted(lines.before, lines.before[a] + least_words)))
                count = far + 1 - b
                end = np.repeat(b - np.cumsum(count) + count, count) + np.arange(count.sum())
                begin = np.minimum(np.repeat(a, count), np.searchsorted(lines.before, lines.before[end] - least_words, side="right") - 1)
                ok = begin >= np.repeat(low, count)
                a, b = np.divmod(np.unique(begin[ok] * (len(lines.starts) + 1) + end[ok]), len(lines.starts) + 1)  # marks near each other share windows
                n, low = at + lines.text[a], lines.firsts[lines.text[a]]
                columns = (ids[n], keys[n], (a - low).astype(np.int32), (b - low).astype(np.int32), sums(lines.hash, a, b).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i_", "k_", "first", "end_", "h"])

    def read(batches):
        """The lines at and around each mark: ``reach`` on either side of its passage, and more until they have ``least_words`` words.

        Hashes go on only with a passage that may turn out to be short.
        """
        for batch in batches:
            bounds, marks = flat(batch.column("marks"))
            for at, lines in in_blocks(batch.column("t_"), False):
                n, row, a, b, low, high = marks_of(lines, at, bounds, marks)
                begin, end = (np.clip(x, low, high) for x in (a - marks["up"].to_numpy()[n], b + marks["down"].to_numpy()[n]))
                top = np.maximum(low, np.minimum(begin - reach, np.searchsorted(lines.before, lines.before[begin] - least_words, side="right") - 1))
                bottom = np.minimum(high, np.maximum(end + reach, np.searchsorted(lines.before, lines.before[end] + least_words)))
                hashes = marks["hashes"].take(pa.array(n, mask=lines.before[end] - lines.before[begin] >= least_words))
                text, starts = lines.stripped()
                n, row, places = pa.array(n), pa.array(row), [starts[x] for x in (top, a, b, bottom)]
                spots = (*(marks[c].take(n) for c in ("h", "low", "high", "lead")), *(batch.column(c).take(row) for c in ("i_", "k_")), *(marks[c].take(n) for c in ("first", "end_")), hashes)
                heads = ["h", "low", "high", "lead", "i_", "k_", "a", "b", "hashes", "before", "chunk", "after"]
                yield pa.RecordBatch.from_arrays([*spots, *(strings(text, x, y) for x, y in itertools.pairwise(places))], heads)

    def marked(spots: DataFrame, *more: str) -> DataFrame:
        """The texts at ``spots`` with a list of these."""
        marks = spots.groupBy("i_", "k_").agg(F.collect_set(F.struct("first", "end_", "h", *more)).alias("marks"))
        return texts.withColumnRenamed(names[at_text], "t_").join(marks.hint("shuffle_hash"), ["i_", "k_"])  # texts are not sorted

    def compare(batches):
        """Copies against the first occurrence that leads them: rows come by hash and part, the lead before its copies.

        Copies are told by columns where they are equal with all that is before or after them.
        """
        tail = []  # the lead of the last rows, which may lead more

        def listed(text: str, step: int) -> list:
            """Lines, those before a run upwards."""
            return text.split("\n")[:-1][::step]

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([*tail, batch]).combine_chunks().to_batches()[0]
            column = {c: batch.column(c) for c in batch.schema.names}
            lead, h, part, a, b = (column[c].to_numpy(zero_copy_only=False) for c in ("lead", "h", "part", "a", "b"))
            led = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), -1))
            tail = [batch.take(pa.array(led[-1:]))] if led[-1] >= 0 else []
            copy = np.flatnonzero(~lead & (led >= 0))
            copy = copy[(h[copy] == h[led[copy]]) & (part[copy] == part[led[copy]])]
            equal = lambda c: pc.equal(column[c].take(pa.array(copy)), column[c].take(pa.array(led[copy]))).to_numpy(zero_copy_only=False)
            copy = copy[equal("chunk")]
            leads, own = np.unique(led[copy], return_inverse=True)
            around = [column[c].take(pa.array(leads)).to_pylist() for c in ("chunk", "before", "after")]
            words = np.array([sum(len(x.split()) for x in texts) for texts in zip(*around)], dtype=np.int64)[own]
            up, down = (np.array([x.count("\n") for x in around[k]], dtype=np.int32)[own] for k in (1, 2))
            for c, step, of_lead, lines in (("before", -1, around[1], up), ("after", 1, around[2], down)):
                differ, last = np.flatnonzero(~equal(c)), -1
                for n, m, text in zip(differ.tolist(), own[differ].tolist(), column[c].take(pa.array(copy[differ])).to_pylist()):
                    if m != last:
                        last, x_0 = m, listed(of_lead[m], step)
                        of_x = list(itertools.accumulate((len(t.split()) for t in x_0), initial=0))
                    lines[n] = agree(listed(text, step), x_0)
                    words[n] -= of_x[-1] - of_x[lines[n]]
            for n in np.flatnonzero(words < least_words).tolist():  # lines that agree in part
                for c, step, of_lead, lines in (("before", -1, around[1], up), ("after", 1, around[2], down)):
                    words[n] += shared_words(listed(column[c][int(copy[n])].as_py(), step), listed(of_lead[own[n]], step), lines[n], step)
            enough = words >= least_words
            hashes = column["hashes"].take(pa.array(copy, mask=enough))
            columns = [*(column[c].take(pa.array(copy)) for c in ("i_", "k_")), pa.array(a[copy] - up), pa.array(b[copy] + down), pa.array(enough), hashes]
            yield pa.RecordBatch.from_arrays(columns, ["i_", "k_", "a", "b", "enough", "hashes"])

    def compared(spots: DataFrame, least: DataFrame, name: str) -> DataFrame:
        """How far the lines at and around ``spots`` agree with the first occurrence of each hash, of whose copies a part goes to each task.

        Copies and first occurrences are read from the texts in one pass and meet in one shuffle.
        """
        part = F.pmod(F.xxhash64("i_", "k_"), F.col("parts")).cast("int")
        dealt = spots.select("i_", "k_", "first", "end_", "h", part.alias("low"), (part + 1).alias("high"), F.lit(False).alias("lead"), "up", "down", "hashes")
        led = least.join(spots.groupBy("h").agg(F.max("up").alias("up"), F.max("down").alias("down")), "h")  # a lead reaches as far as any of its copies
        needed = led.select("least.i_", "least.k_", "least.first", "least.end_", "h", F.lit(0).alias("low"), F.col("parts").alias("high"), F.lit(True).alias("lead"), "up", "down", F.lit(None).cast("array<long>").alias("hashes"))
        schema = "h long, low int, high int, lead boolean, i_ long, k_ long, a int, b int, hashes array<long>, before string, chunk string, after string"
        lines = marked(dealt.unionByName(needed), "low", "high", "lead", "up", "down", "hashes").mapInArrow(read, schema)
        lines = lines.withColumn("part", F.explode(F.sequence("low", F.col("high") - 1))).drop("low", "high")
        met = lines.repartition("h", "part").sortWithinPartitions("h", "part", F.desc("lead"))
        return materialize(met.mapInArrow(compare, "i_ long, k_ long, a int, b int, enough boolean, hashes array<long>"), name)

    near = compared(picked, least, "near")
    for done in (picked, least):
        drop_table(done)
    # a run that agrees with too little around its first occurrence may belong to a passage that first occurs elsewhere
    short = materialize(near.where("not enough").select(F.explode("hashes").alias("h")).distinct(), "short")
    around = materialize(marked(seen.join(short.hint("shuffle_hash"), "h", "left_semi")).mapInArrow(windows, SPOT), "windows")
    for done in (seen, short):
        drop_table(done)
    seen, least = repeats(around)
    later = passages(seen, least, "later")
    far = compared(later, least, "far")
    for done in (around, seen, least, later):
        drop_table(done)
    gone = near.unionByName(far).where("enough")
    ranges = gone.groupBy("i_", "k_").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))

    def rewrite(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            columns = [pc.struct_field(batch.column("row_"), [n]) for n in range(len(names))]
            counts = [0] * batch.num_rows
            bounds, ranges = flat(batch.column("ranges"))
            if bounds[-1]:
                values = columns[at_text].cast(pa.binary()).to_pylist()
                a, b = (ranges[c].to_numpy() for c in ("a", "b"))
                changed = np.flatnonzero(np.diff(bounds))
                for first, lines in in_blocks(columns[at_text].take(pa.array(changed)), False):
                    for k, n in enumerate(changed[first : first + len(lines.raw)].tolist()):
                        values[n], counts[n] = lines.without(k, a[bounds[n] : bounds[n + 1]], b[bounds[n] : bounds[n + 1]])
                columns[at_text] = pa.array(values, pa.binary()).cast(columns[at_text].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, out])

    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in zip(kept, names)] + [T.StructField(out, T.LongType())])
    result = keyed.join(ranges.hint("shuffle_hash"), ["i_", "k_"], "left").select("row_", "ranges").mapInArrow(rewrite, schema)
    return result.select(*(F.col(n).alias(c) for c, n in zip(kept, names)), F.col(out))
