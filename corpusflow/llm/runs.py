"""Operator 12: periodic runs of words, found on a grammar.

The words of a block of texts are numbered and compressed by Re-Pair (Larsson and
Moffat, 1999): pairs of neighbours that occur again become nonterminals, frequent
ones first, and what is left over is joined pairwise up to one symbol.  Every run
crosses the boundary between the two halves of the smallest nonterminal that holds
it, so runs over each nonterminal's boundary are computed once, whatever the number
of its derivations, and carried to all positions where it is derived.  A run that a
nonterminal holds in part only lies inside one that a larger one holds whole; the
intervals of one period are merged to maximal ones.

Words go into the grammar only where a run can be.  In a run of period q each pair
of neighbours after the first q has occurred q words before, so stretches of pairs
that did not occur recently enough to leave room for ``EXPONENT`` periods hold none.
"""

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct

EXPONENT, LEAST = 4, 6
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RUNS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")])
RUNS = RUNS.add("runs", T.ArrayType(RUN)).add("collapsed", "string").add("runs_sha256", "string").add("collapsed_sha256", "string")


def stretches(flags: np.ndarray) -> tuple:
    """First and one past last of each stretch of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def regions(words: np.ndarray, text: np.ndarray) -> tuple:
    """(first, end) of the parts of the block that may hold runs, each inside one text.

    A part reaches one word further than any run that it may hold, so a run inside is
    maximal in its text.
    """
    n = len(words)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = words[:-1].astype(np.int64) << 32 | words[1:]
    order = np.argsort(pair, kind="stable")
    again = (pair[order][1:] == pair[order][:-1]) & (text[order][1:] == text[order][:-1])
    gap = np.full(n - 1, n, dtype=np.int64)
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    flags = (gap < n) & (text[:-1] == text[1:])
    for _ in range(4):
        first, end = stretches(flags)
        room = np.zeros(n - 1, dtype=np.int64)
        size = end - first
        fits = size >= LEAST - 2
        first, end, size = first[fits], end[fits], size[fits]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        room[at] = np.repeat((size + 1) // (EXPONENT - 1), size)
        now = flags & (gap <= room)
        if (now == flags).all():
            break
        flags = now
    first, end = stretches(flags)
    fits = end - first >= LEAST - 2
    first, end = first[fits], end[fits]
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    own = np.searchsorted(starts, first, side="right") - 1
    low, high = starts[own], np.append(starts[1:], n)[own]
    left, right = np.maximum(low, first - (end - first + 1) // (EXPONENT - 1) - 1), np.minimum(high, end + 2)
    if not len(left):
        return left, right
    order = np.lexsort((left, own))  # parts of a text that overlap become one
    left, right, own = left[order], right[order], own[order]
    reach = np.maximum.accumulate(right)
    new = np.concatenate(([True], (left[1:] >= reach[:-1]) | (own[1:] != own[:-1])))
    return left[new], np.maximum.reduceat(right, np.flatnonzero(new))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift in (33, 29, 32):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x9E3779B97F4A7C15)
    return x


class Grammar:
    """A straight-line grammar of a sequence whose parts are told apart by ``part``.

    ``left``, ``right``: the halves of each nonterminal, which are numbered from
    ``base`` on; ``first``: where one derivation of it starts; ``size``: of every symbol.
    ``roots``: one symbol for each part, with its place.
    """

    def __init__(self, words: np.ndarray, part: np.ndarray):
        self.base = int(words.max()) + 1 if len(words) else 0
        self.left, self.right, self.first = [], [], []
        self.count, self.sizes = self.base, [np.ones(self.base, dtype=np.int64)]
        symbols, at = words.astype(np.int64), np.arange(len(words))
        symbols, at, part = self.pairs(symbols, at, part)
        self.roots, self.places = self.balance(symbols, at, part)
        self.left, self.right, self.first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.right, self.first))
        self.size = np.concatenate(self.sizes)

    def add(self, left, right, first) -> np.ndarray:
        size = np.concatenate(self.sizes)
        self.sizes = [np.append(size, size[left] + size[right])]
        self.left.append(left)
        self.right.append(right)
        self.first.append(first)
        self.count += len(left)
        return np.arange(self.count - len(left), self.count)

    def pairs(self, symbols, at, part) -> tuple:
        """Re-Pair in rounds: a pair is replaced where it comes before the pairs that overlap it, more frequent ones first.

        Counts are compared by their powers of two and then by a hash, so that a round replaces
        pairs all over the sequence; a pair of equal symbols is replaced at every second
        place of a stretch.
        """
        while len(symbols) > 1:
            same = part[1:] == part[:-1]
            key = symbols[:-1] * self.count + symbols[1:]
            key[~same] = -1
            known, which, times = np.unique(key, return_inverse=True, return_counts=True)
            rank = np.argsort(np.lexsort((mixed(known), np.log2(times).astype(np.int64))))
            weight = np.where(same & (times[which] > 1), rank[which] + 1, 0)
            ahead = np.concatenate(([0], weight[:-1]))
            behind = np.append(weight[1:], 0)
            chosen = (weight > 0) & (weight >= ahead) & (weight >= behind)
            first, end = stretches(chosen)
            inside = np.arange(len(chosen)) - np.repeat(first, end - first)[np.cumsum(chosen) - 1] if len(first) else np.zeros(len(chosen), np.int64)
            # neighbours chosen together have one weight: a stretch of one symbol
            chosen &= inside % 2 == 0
            enough = np.bincount(which[chosen], minlength=len(known)) > 1
            chosen &= enough[which]
            spots = np.flatnonzero(chosen)
            if not len(spots):
                break
            _, lead, number = np.unique(which[spots], return_index=True, return_inverse=True)
            lead = spots[lead]
            made = self.add(symbols[lead], symbols[lead + 1], at[lead])
            symbols = symbols.copy()
            symbols[spots] = made[number]
            keep = np.ones(len(symbols), dtype=bool)
            keep[spots + 1] = False
            symbols, at, part = symbols[keep], at[keep], part[keep]
        return symbols, at, part

    def balance(self, symbols, at, part) -> tuple:
        """Neighbours are joined two by two until each part is one symbol."""
        while len(symbols) > 1:
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            inside = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
            spots = np.flatnonzero((inside[:-1] % 2 == 0) & (part[1:] == part[:-1]))
            if not len(spots):
                break
            symbols = symbols.copy()
            symbols[spots] = self.add(symbols[spots], symbols[spots + 1], at[spots])
            keep = np.ones(len(symbols), dtype=bool)
            keep[spots + 1] = False
            symbols, at, part = symbols[keep], at[keep], part[keep]
        return symbols, at


class Blocks:
    """Names of all blocks of 2**k words, equal exactly where the blocks are: how far words agree from two places on."""

    def __init__(self, words: np.ndarray, most: int):
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 2 << len(self.names) - 1 <= most:
            last, half = self.names[-1], 1 << len(self.names) - 1
            self.names.append(np.unique(last[:-half] * (int(last.max()) + 1) + last[half:], return_inverse=True)[1].astype(np.int64))

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from a and b on, forwards or backwards, ``limit`` at most."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                shift = -(got + size - 1) if back else got
                room = np.flatnonzero(got + size <= limit)
                x, y = (a + shift)[room], (b + shift)[room]
                hit = self.names[k][x] == self.names[k][y]
                got[room[hit]] += size
        return got


def crossing(words: np.ndarray, grammar: Grammar, block: int = 2_000_000) -> tuple:
    """(nonterminal, start inside it, length, period) of the runs over each nonterminal's boundary.

    The period is one at which the last word of the left half comes again, before or
    after: a run of four periods over the boundary agrees with itself there.
    """
    size = grammar.size[grammar.base :]
    node = np.flatnonzero(size >= LEAST)
    start, whole = grammar.first[node], size[node]
    last = start + grammar.size[grammar.left[node]] - 1
    widest = int(whole.max()) if len(whole) else 1
    blocks = Blocks(words, widest)
    name = blocks.names[0]
    order = np.argsort(name, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    spread = name[order] * (len(words) + 1) + order  # occurrences of a word lie side by side, in order
    reach = whole // EXPONENT
    own = name[last] * (len(words) + 1)
    upper = np.searchsorted(spread, own + np.minimum(last + reach, start + whole - 1), side="right") - 1
    lower = np.searchsorted(spread, own + np.maximum(last - reach, start), side="left")
    found = [np.zeros((0, 4), dtype=np.int64)]
    todo = np.concatenate(([0], np.cumsum(upper - lower)))
    cut = np.unique(np.searchsorted(todo, np.arange(0, todo[-1] + block, block), side="left").clip(0, len(node)))
    for lo, hi in zip(cut[:-1], cut[1:]):
        part = np.arange(lo, hi)
        times = (upper - lower)[part] + 1
        which = np.repeat(part, times)
        slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + lower[which]
        other = order[slot]
        which, other = which[other != last[which]], other[other != last[which]]
        here = np.minimum(other, last[which])
        lag = np.abs(other - last[which])
        low, high = start[which], start[which] + whole[which]
        right = blocks.agree(here, here + lag, high - lag - here, False)
        left = blocks.agree(here, here + lag, here - low + 1, True)
        length = left + right - 1 + lag
        fits = length >= np.maximum(LEAST, EXPONENT * lag)
        found.append(np.stack([node[which], here - left + 1 - low, length, lag], 1)[fits])
    return unshadowed(np.concatenate(found))


def unshadowed(rows: np.ndarray) -> np.ndarray:
    """Of equal intervals (owner, start, length) the one with the smallest period."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1)))
    return rows[new]


def derived(grammar: Grammar, rows: np.ndarray) -> np.ndarray:
    """(start, length, period) of the nonterminals' runs at all places where these are derived."""
    counts = np.bincount(rows[:, 0], minlength=len(grammar.left))
    offset = np.concatenate(([0], np.cumsum(counts)))
    useful = counts > 0  # or something below it holds one: children come before their parents
    symbol, at = grammar.roots, grammar.places
    holds = np.concatenate((np.zeros(grammar.base, dtype=bool), useful))
    for a, b in batches_of(grammar):
        k = np.arange(a, b)
        holds[grammar.base + k] |= holds[grammar.left[k]] | holds[grammar.right[k]]
    out = [np.zeros((0, 3), dtype=np.int64)]
    while len(symbol):
        keep = holds[symbol]
        symbol, at = symbol[keep], at[keep]
        k = symbol - grammar.base
        times = counts[k]
        slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(offset[k], times)
        run = rows[slot]
        out.append(np.stack([np.repeat(at, times) + run[:, 1], run[:, 2], run[:, 3]], 1))
        symbol, at = np.concatenate([grammar.left[k], grammar.right[k]]), np.concatenate([at, at + grammar.size[grammar.left[k]]])
    return np.concatenate(out)


def batches_of(grammar: Grammar):
    """Ranges of nonterminals whose halves all come before the range."""
    a, total = 0, len(grammar.left)
    high = np.maximum(grammar.left, grammar.right) - grammar.base
    while a < total:
        late = np.flatnonzero(high[a:] >= a)
        b = a + int(late[0]) if len(late) else total
        yield a, b
        a = b


def merged(rows: np.ndarray) -> np.ndarray:
    """Intervals (start, length, period) of one period that share a period's length or more, as one."""
    if not len(rows):
        return rows
    start, end, period = rows[:, 0], rows[:, 0] + rows[:, 1], rows[:, 2]
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    wide = int(end.max()) + 1
    kind = np.unique(period, return_inverse=True)[1]
    reach = np.maximum.accumulate(end + kind * wide) - kind * wide
    new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (start[1:] > reach[:-1] - period[1:])))
    first = np.flatnonzero(new)
    found = np.stack([start[first], np.maximum.reduceat(end, first) - start[first], period[first]], 1)
    return unshadowed(np.insert(found, 0, 0, axis=1))[:, 1:]


def runs_of(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(start, length, period), in the block's word numbers, of all runs of a block of texts, by start and period."""
    first, end = regions(words, text)
    if not len(first):
        return np.zeros((0, 3), dtype=np.int64)
    size = end - first
    begin = np.cumsum(size) - size
    part = np.repeat(np.arange(len(first)), size)
    shift = first - begin
    inner = words[np.arange(size.sum()) + shift[part]]
    inner = np.unique(inner, return_inverse=True)[1]
    grammar = Grammar(inner, part)
    rows = merged(derived(grammar, crossing(inner, grammar)))
    rows[:, 0] += shift[part[rows[:, 0]]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def described(words: list, runs: list) -> dict:
    """The struct of one text from its words and its runs (start, length, period)."""
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    collapsed = " ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d] if runs else words)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return {
        "n_words": len(words), "n_runs": len(runs), "start": top and top[0], "length": top and top[1], "period": top and top[2], "exponent_milli": top and 1000 * top[1] // top[2],
        "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs], "collapsed": collapsed,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed.encode()).hexdigest(),
    }


def find_all(texts: list) -> list:
    """One struct for each text; the texts share a grammar, and no run leaves its text."""
    split = [WORDS.findall(t) if t else [] for t in texts]
    numbers: dict = {}
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(split)), sizes)
    begin = np.cumsum(sizes) - sizes
    of_text: list = [[] for _ in split]
    for s, n, p in runs_of(ids, owner).tolist():
        k = int(owner[s])
        of_text[k].append((s - int(begin[k]), n, p))
    return [described(w, r) for w, r in zip(split, of_text)]


def find_runs(docs: DataFrame, text: str = "text", out: str = "found", block: int = 2_000_000) -> DataFrame:
    """``docs`` and a struct ``out``: runs, the longest one, the words without their repeats, and digests.

    A null text counts as empty: no words, no runs, four nulls.  Texts are read whole,
    whatever their length; about ``block`` characters share a grammar.  Of runs of equal length the
    longest is the one with the smallest start, then period.  Repeated rows give equal
    structs; an empty table stays empty.  A column of the name ``out`` is replaced, all
    others pass through.
    """

    def prepare():
        def work(texts):
            made, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size >= block:
                    made += find_all(held)
                    held, size = [], 0
            return made + find_all(held)

        return work

    return append_struct(docs, text, out, RUNS, prepare)
