"""Operator 6: language identification by string kernels.

The kernel of two texts counts the blended n-grams (1 to ``max_n`` characters)
that both hold, whatever their frequency, divided by the geometric mean of each
text's own count (n-grams are told apart by a hash of 20 bits).  Landmark texts stand for all training texts (Nystroem): the
kernel to the landmarks, whitened by the landmarks' own kernel, is the feature
vector, and one ridge regression against +1 and -1 is solved for each language.
Texts are scored in batches by two matrix products: presence of n-grams times the
landmarks' n-grams, then kernel values times the dual weights.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct

PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SLOT_BITS = 20
#: The world has some 7,000 languages.
MOST_LANGS = 10_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def has_letter(text) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_slots(text: str, max_n: int):
    """Arrays of hash slots, one for each n-gram length, over the lower-cased text in pieces."""
    text = " " + text.lower() + " "
    piece = 1 << 20
    for at in range(0, len(text), piece):
        codes = np.frombuffer(text[at : at + piece + max_n - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        codes[(codes >= 48) & (codes <= 57)] = 48
        rolled = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max_n + 1):
            if len(codes) < n:
                break
            rolled = rolled[: len(codes) - n + 1] * MIX[0] + codes[n - 1 :] + np.uint64(n)
            yield ((rolled * MIX[1]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def presence(texts: list, slots: np.ndarray, width: int, max_n: int) -> tuple:
    """Which n-grams of the landmarks each text holds (column ``width`` takes all others), and how many n-grams each has."""
    held, own = np.zeros((len(texts), width + 1), dtype=np.float32), np.zeros(len(texts), dtype=np.float32)
    seen = np.zeros(1 << SLOT_BITS, dtype=bool)
    for k, text in enumerate(texts):
        every = list(gram_slots(text, max_n))
        for grams in every:
            held[k, slots[grams]] = 1
            seen[grams] = True
        own[k] = np.count_nonzero(seen)
        for grams in every:
            seen[grams] = False
    return held, own


class KernelModel:
    def __init__(self, texts: list, langs: list, landmarks: int, max_n: int, ridge: float, seed: int):
        self.langs = sorted(set(langs))
        self.max_n = max_n
        rng = np.random.default_rng(seed)
        chosen = np.sort(rng.permutation(len(texts))[: min(landmarks, len(texts))])
        sets = [np.unique(np.concatenate([np.unique(g) for g in gram_slots(texts[k], max_n)] or [np.zeros(0, np.int64)])) for k in chosen]
        count = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        for s in sets:
            count[s] += 1
        known = np.flatnonzero(count)
        self.width = len(known)
        self.slots = np.full(1 << SLOT_BITS, self.width, dtype=np.int32)
        self.slots[known] = np.arange(self.width)
        marks, size = presence([texts[k] for k in chosen], self.slots, self.width, max_n)
        self.marks, self.size = marks[:, : self.width].T.copy(), np.sqrt(np.maximum(size, 1))
        own = self.kernel([texts[k] for k in chosen])
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        keep = values > 1e-6 * max(values.max(), 1e-9)
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        gram, cross = np.zeros((keep.sum() + 1,) * 2), np.zeros((keep.sum() + 1, len(self.langs)))
        place = {lang: k for k, lang in enumerate(self.langs)}
        weight = len(texts) / np.maximum(np.bincount([place[x] for x in langs], minlength=len(self.langs)), 1)
        for at in range(0, len(texts), 256):
            part = self.kernel(texts[at : at + 256]) @ whiten
            part = np.hstack([part, np.ones((len(part), 1))])
            label = [place[x] for x in langs[at : at + 256]]
            target = np.where(np.arange(len(self.langs)) == np.array(label)[:, None], 1.0, -1.0)
            w = weight[label][:, None]
            gram += part.T @ (w * part)
            cross += part.T @ (w * target)
        solved = np.linalg.solve(gram + ridge * weight.mean() * np.eye(len(gram)), cross)
        self.dual, self.bias = (whiten @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def kernel(self, texts: list) -> np.ndarray:
        held, own = presence(texts, self.slots, self.width, self.max_n)
        return (held[:, : self.width] @ self.marks) / self.size / np.sqrt(np.maximum(own, 1))[:, None]

    def predict(self, texts: list) -> list:
        """A language and a score from 0 to 1 for each text; ``und`` without any letter."""
        out = [{"lang_pred": "und", "score": 0.0} for _ in texts]
        some = [k for k, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(some), 128):
            rows = some[at : at + 128]
            margins = self.kernel([texts[k] for k in rows]) @ self.dual + self.bias
            best = margins.argmax(1)
            for k, b, m in zip(rows, best.tolist(), margins.max(1).tolist()):
                out[k] = {"lang_pred": self.langs[b], "score": min(1.0, max(0.0, (m + 1) / 2))}
        return out


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = 600, landmarks: int = 192, max_n: int = 4, ridge: float = 0.3, seed: int = 7) -> KernelModel | None:
    """Fit on a bounded sample of labelled documents that are not held out.

    The bound is about ``per_lang`` documents of each language, those with the
    smallest hash of id and text, so the sample needs no order and does not depend on
    partitions; rows equal in id, language and text count once.  Every language is
    learned, from whole texts; more than ``MOST_LANGS`` of them are an error.  None
    without any labelled text.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} different values of lang: these are no languages")
    if not counts:
        return None
    scale = 1 << 30
    limits = [(r["lang"], int(scale * min(1.0, per_lang / r["count"]))) for r in counts]
    known = docs.sparkSession.createDataFrame(limits, "lang string, limit_ long")
    drawn = labelled.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < F.col("limit_"))
    rows = drawn.select("doc_id", "lang", "text").distinct().collect()
    rows = sorted((r for r in rows if has_letter(r["text"])), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))
    if not rows:
        return None
    return KernelModel([r["text"] for r in rows], [r["lang"] for r in rows], landmarks, max_n, ridge, seed)


def identify(docs: DataFrame, model: KernelModel | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` and one struct column ``out``: lang_pred and score, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; without a model
    every text is.  Of languages that score alike the first by name is told.  Each row is judged by itself, so repeated rows get equal
    results; a column of the name ``out`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shipped.value
        return model.predict if model else lambda texts: [{"lang_pred": "und", "score": 0.0} for _ in texts]

    return append_struct(docs, text, out, PREDICTED, prepare)
