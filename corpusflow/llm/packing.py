"""Operator 7: packing documents into fixed-length training sequences.

Every document becomes its token ids and an end id.  Documents over the capacity
are cut into full pieces; all other documents stay whole.  The packing plan needs
only how many pieces there are of each length, at most ``capacity`` numbers
whatever the size of the corpus.  The plan is made by exact-complement hashing:
single lengths, sums of pairs and sums of triples that fill the gap beside a
piece exactly are consumed under their availability counts; what then remains is
placed best fit, longest first.  Pieces of one length are interchangeable, so a
piece finds its place from its rank among the pieces of its length.
"""

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Characters of which Python and the tokenizer agree on composition, case and class.
PLAIN = re.compile("[!-~\u00a1-\u024f]+")
#: The tokenizer's own split into tokens, its normalizers and the bytes that stand for themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
OWN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}


def byte_names() -> dict:
    """The character for each byte (as Latin-1): bytes without one of their own follow from 256 on."""
    others = [b for b in range(256) if b not in OWN_BYTES]
    return {b: 256 + k for k, b in enumerate(others)}


def splits_as_known(tokenizer_json: str) -> bool:
    """Whether the file normalizes and splits as ``WordIds`` takes for granted."""
    d = json.loads(tokenizer_json)
    kinds = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])]
    split = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return kinds == NORMALIZERS and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": SPLIT}


class WordIds(dict):
    """Token ids, as little-endian bytes, of stretches of text that hold no blank or line end.

    The tokenizer drops white space and no token crosses it, so a text's ids are
    the ids of its stretches one after the other.  Stretches repeat, and each is
    encoded once while the table has room.  A stretch of plain characters is split
    here by the tokenizer's own expression and goes to the model alone; any other
    is encoded by the whole tokenizer.
    """

    def __init__(self, tokenizer, room: int = 400_000):
        super().__init__()
        self.tokenizer, self.model, self.room = tokenizer, tokenizer.model, room
        self.parts: dict = {}
        self.split, self.names = regex.compile(SPLIT).findall, byte_names()

    def part(self, piece: str) -> bytes:
        ids = self.parts.get(piece)
        if ids is None:
            named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
            ids = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
            if len(self.parts) < self.room and len(piece) <= 64:
                self.parts[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            ids = self.part(low) if low.isalpha() else b"".join(map(self.part, self.split(low)))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < self.room and len(word) <= 64:
            self[word] = ids
        return ids


def text_ids(text, words: WordIds) -> bytes:
    if not text:
        return b""
    flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    return b"".join(map(words.__getitem__, flat.split(" ")))


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the end id alone.  Repeated rows give repeated pieces.
    A vocabulary that normalizes or splits in another way is refused.
    """
    if not splits_as_known(tokenizer_json):
        raise ValueError("the tokenizer's normalizers or its split are not those that stretches rest on")
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        from tokenizers import Tokenizer

        words = WordIds(Tokenizer.from_str(shipped.value))
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = text_ids(text, words) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(lengths: dict, capacity: int) -> list:
    """Patterns ``(lengths of one sequence, how many such sequences)`` that use up all pieces.

    Each step exhausts a length or a group of open sequences, so the number of
    patterns depends on the capacity and not on the number of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in lengths.items():
        left[length] = count
    patterns = []

    def take(combo):
        need = {}
        for length in combo:
            need[length] = need.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in need.items())
        if times:
            patterns.append((tuple(combo), times))
            for length, n in need.items():
                left[length] -= n * times
        return times

    def pair(total):
        """Two available lengths with this sum, the longest first."""
        low = np.arange(1, total // 2 + 1)
        fits = low[(left[low] > 0) & (left[total - low] > 0)]
        fits = fits[(2 * fits != total) | (left[fits] > 1)]
        return (int(total - fits[0]), int(fits[0])) if len(fits) else None

    def triple(total):
        for a in np.flatnonzero(left[: max(total - 1, 0)])[::-1]:
            if rest := pair(total - int(a)):
                combo = (int(a), *rest)
                if all(left[x] >= combo.count(x) for x in combo):
                    return combo
        return None

    for length in range(capacity, 0, -1):
        gap = capacity - length
        while left[length] > 0:
            combo = () if not gap else (gap,) if left[gap] > 0 else pair(gap) or triple(gap)
            if combo is None or not take((length, *combo)):
                break

    open_count = np.zeros(capacity + 1, dtype=np.int64)
    opened: dict[int, list] = {}

    def keep(combo, times):
        gap = capacity - sum(combo)
        opened.setdefault(gap, []).append([combo, times])
        open_count[gap] += times

    for length in range(capacity, 0, -1):
        while left[length] > 0:
            gaps = np.flatnonzero(open_count[length:])
            if len(gaps):
                gap = int(gaps[0]) + length
                group = opened[gap][-1]
                times = min(int(left[length]), group[1])
                group[1] -= times
                open_count[gap] -= times
                if not group[1]:
                    opened[gap].pop()
                keep((*group[0], length), times)
                left[length] -= times
            else:
                each = capacity // length
                full, rest = divmod(int(left[length]), each)
                if full:
                    keep((length,) * each, full)
                if rest:
                    keep((length,) * rest, 1)
                left[length] = 0
    return patterns + [(combo, times) for groups in opened.values() for combo, times in groups if times]


def slots(patterns: list) -> dict:
    """For the pieces of each length, by rank: the first sequence and the offset of each run of places."""
    rows, used, first = [], {}, 0
    for combo, times in patterns:
        offset = 0
        for length in combo:
            start = used.get(length, 0)
            rows.append((length, start, first, offset))
            used[length] = start + times
            offset += length
        first += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "start": table[:, 1], "first": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, rows_a_group: int = 50_000) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset.

    Pieces of one length are ranked in groups by a hash, so that a length that a
    third of the corpus shares is ranked by many tasks; the groups' counts give
    each group its first rank.  Equal rows may change places with each other.  An
    empty input gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer_json, capacity, end_id), "pieces")
    groups = max(16, -(-cut.count() // rows_a_group))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = salted.groupBy("length", "salt").count()
    lengths = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(lengths, capacity)))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(own) - 1)
        .join(bases, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    )

    def place(batches):
        s = places.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(s["key"], (length << 44) + rank, side="right") - 1
            seq = s["first"][at] + rank - s["start"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seq), pa.array(s["offset"][at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PLACED)


def tokenizer_json(path: str) -> str:
    """The vocabulary file, read on the driver and sent to the executors (a fixed few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
