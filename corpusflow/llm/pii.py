"""Operator 4: personal data, by fixed expressions and by a trained character tagger.

Base spans (e-mail, ip, card, phone) are found by their expressions and checks and
always stay.  A bidirectional LSTM with CRF transitions, trained in numpy from
labelled spans, adds written forms that the expressions miss.  It runs over
overlapping windows; the spans decoded in all windows of a text are reconciled at
once: pieces cut by a window's edge join, and of spans that overlap those of the
greatest total score stay.

A span must hold a digit or an at-sign (or a spelled-out one), so windows without
any are outside by definition and need no decoding.
"""

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, spans_string
from .tagger import PAD, Tagger, encode, fit

KINDS = ["email", "ip", "card", "phone"]
ORDER = {k: n for n, k in enumerate(KINDS)}
LENGTH, STRIDE = 64, 32
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.I)
#: What an added span must look like, whatever the tagger says.
AT, DOT = r"\s?(?:@|[(\[{] ?at ?[)\]}])\s?", r"\s?(?:\.|[(\[{] ?dot ?[)\]}])\s?"
SHAPE = {
    "email": re.compile(rf"[\w%+-]+(?:{DOT}[\w%+-]+)*{AT}[\w-]+(?:{DOT}[\w-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|[(\[]dot[)\]]) ?[0-9]{1,3}){3}", re.I),
    "card": re.compile(r"[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}|[0-9]{4}[ ._/-]{1,2}[0-9]{6}[ ._/-]{1,2}[0-9]{5}"),
    "phone": re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
}
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    + [T.StructField("parts", T.ArrayType(SPAN)), T.StructField("n_added", T.LongType())]
)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list:
    """Leftmost matches without overlap, in one pass over the at-signs."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        # what a longer local part would have taken before an earlier at-sign is not taken again
        if m:
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list:
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m.groups()):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def plausible(kind: str, piece: str) -> bool:
    if not SHAPE[kind].fullmatch(piece):
        return False
    if kind == "ip":
        return all(int(x) < 256 for x in re.findall("[0-9]+", piece))
    return kind != "card" or luhn(re.sub("[^0-9]", "", piece))


def synthetic(rng: random.Random) -> tuple:
    """A labelled written form, or a number that is none (kind None)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvwz") for _ in range(rng.randint(2, 8)))
    draw = rng.random()
    if draw < 0.25:
        at = rng.choice(["@", "@", " @ ", " (at) ", "(at)", " [at] ", "[at]", " (AT) "])
        dot = rng.choice([".", ".", " . ", " (dot) ", "[dot]", " [dot] "]) if at != "@" else rng.choice([".", "[.]", " (dot) ", "."])
        name = rng.choice([word(), digits(2), f"{word()}.{word()}", f"{word()}{digits(2)}"])
        return "email", name + at + dot.join([word() + rng.choice(["", digits(1)]), *[word() for _ in range(rng.randint(0, 1))], rng.choice(["com", "org", "net", "de", "fr"])])
    if draw < 0.4:
        return "ip", rng.choice([".", ".", "[.]", " . ", "(dot)"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if draw < 0.55:
        number = rng.choice("3456") + digits(14)
        number += next(d for d in "0123456789" if luhn(number + d))
        return "card", rng.choice(["", "", " ", "-", ".", "/", "_", ". "]).join(number[k : k + 4] for k in range(0, 16, 4))
    if draw < 0.75:
        a, b, c = digits(3), digits(3), digits(4)
        return "phone", rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}"])
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40)))
    return None, rng.choice([
        str(rng.randint(1900, 2030)), f"{rng.randint(0, 99)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}",
        f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"${digits(1)},{digits(3)}.00", hexes, hexes, digits(rng.randint(5, 13)), f"@{word()}",
        f"{digits(3)}-{digits(1)}-{digits(2)}", f"{digits(4)}/{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"id={digits(6)}",
    ])


def examples(texts: list, size: int, seed: int) -> list:
    """Labelled windows: base spans where they stand, written forms set into running text, and plain text."""
    rng, out = random.Random(seed), []
    texts = [t for t in texts if t] or ["a text without any label, as a start."]
    for text in texts:
        for kind, a, b in base_spans(text)[:3]:
            if b - a < LENGTH:
                start = max(0, a - rng.randint(0, LENGTH - (b - a)))
                piece = text[start : start + LENGTH]
                out.append((piece, [(k, x - start, y - start) for k, x, y in base_spans(text) if x >= start and y <= start + len(piece)]))
    rng.shuffle(out)
    out = out[: size // 4]
    while len(out) < size:
        text = rng.choice(texts)
        at = rng.randrange(max(1, len(text) - LENGTH))
        context = text[at : at + 2 * LENGTH]
        if rng.random() < 0.1 and not TRIGGER.search(context[:LENGTH]):
            out.append((context[:LENGTH], []))
            continue
        kind, form = synthetic(rng)
        cut = rng.randint(0, LENGTH - min(len(form), LENGTH))
        left = re.sub(TRIGGER, "a", context[:cut])
        left = left[: -1] + " " if left and not left[-1].isspace() else left
        tail = rng.choice([" ", " ", ". ", ", ", "\n", ""])
        piece = (left + form + (tail or " ") + re.sub(TRIGGER, "a", context[cut:]))[:LENGTH]
        out.append((piece, [(kind, len(left), min(len(left) + len(form), LENGTH))] if kind else []))
    return out


def train(docs: DataFrame, texts: int = 400, windows: int = 3000, hidden: int = 20, steps: int = 260, seed: int = 11) -> Tagger:
    """Fit on labelled windows from a bounded sample of about ``texts`` whole documents.

    They are those with the smallest hash of id and text; equal rows count once.
    """
    count = max(1, docs.count())
    scale = 1 << 30
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(scale)) < int(scale * min(1.0, texts / count)))
    rows = [r["text"] for r in sample.select("doc_id", "text").distinct().collect() if r["text"]]
    return fit(examples(sorted(rows), windows, seed), KINDS, hidden, LENGTH, steps, seed)


def reconcile(found: list) -> list:
    """Spans of one text from all windows: (kind, start, end, score, cut).  No two of the result overlap."""
    joined: list = []
    for kind, a, b, score, cut in sorted(found, key=lambda s: (s[0], s[1], s[2])):
        last = joined[-1] if joined else None
        if last and last[0] == kind and a < last[2] and (cut or last[4]):
            last[2], last[3], last[4] = max(b, last[2]), max(score, last[3]), cut and last[4]
        else:
            joined.append([kind, a, b, score, cut])
    joined.sort(key=lambda s: s[2])
    ends = [s[2] for s in joined]
    best = [(0.0, -1, -1)]  # total, span taken, earlier place
    for k, (_, a, b, score, _) in enumerate(joined):
        before = bisect_right(ends, a, 0, k)
        take = best[before][0] + score * (b - a)
        best.append((take, k, before) if take > best[-1][0] else (best[-1][0], -1, k))
    out, at = [], len(joined)
    while at > 0:
        _, k, before = best[at]
        if k >= 0:
            out.append(tuple(joined[k][:4]))
        at = before
    return out[::-1]


def tagged(texts: list, tagger: Tagger, sure: float) -> list:
    """For each text the reconciled spans of the tagger with a mean probability of at least ``sure``."""
    where, parts, sizes = [], [], []
    for row, text in enumerate(texts):
        if not text:
            continue
        starts: set = set()
        for m in TRIGGER.finditer(text):
            k = m.start() // STRIDE
            starts.add(k)
            if k:
                starts.add(k - 1)
        for k in sorted(starts):
            piece = text[k * STRIDE : k * STRIDE + LENGTH]
            where.append((row, k * STRIDE))
            parts.append(piece)
            sizes.append(len(text))
    found: dict = {}
    for at in range(0, len(parts), 4096):
        some = parts[at : at + 4096]
        codes = np.full((len(some), LENGTH), PAD, np.int64)
        joined = encode("".join(some))
        long = np.array([len(p) for p in some])
        codes[np.arange(LENGTH) < long[:, None]] = joined
        tags, odds = tagger.decode(codes)
        for r in np.flatnonzero((tags > 0).any(1)).tolist():
            row, offset = where[at + r]
            line, k = tags[r].tolist(), 0
            while k < long[r]:
                if line[k] and line[k] % 2:
                    end = k + 1
                    while end < long[r] and line[end] == line[k] + 1:
                        end += 1
                    score = float(odds[r, k:end].mean())
                    if score >= sure:
                        cut = (k == 0 and offset > 0) or (end == LENGTH and offset + end < sizes[at + r])
                        found.setdefault(row, []).append((KINDS[line[k] // 2], offset + k, offset + end, score, cut))
                    k = end
                else:
                    k += 1
    return [reconcile(found.get(row, [])) for row in range(len(texts))]


def scan(texts: list, tagger: Tagger, sure: float) -> list:
    out = []
    for text, more in zip(texts, tagged(texts, tagger, sure)):
        text = text or ""
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for kind, a, b, _ in more:
            a, b = a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip(" \n\t.,;:"))
            if plausible(kind, text[a:b]) and all(y <= a or x >= b for x, y in taken):
                added.append((kind, a, b))
        every = sorted(base + added, key=lambda s: (s[1], ORDER[s[0]]))
        out.append(
            {
                **{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS},
                "base_sha256": hashlib.sha256(spans_string(base, ORDER).encode()).hexdigest(),
                "spans": spans_string(every, ORDER),
                "parts": [{"kind": k, "start": a, "end": b} for k, a, b in every],
                "n_added": len(added),
            }
        )
    return out


def find_personal_data(docs: DataFrame, tagger: Tagger, sure: float = 0.9, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` and one struct column ``out``: counts and digest of the base spans, and all spans.

    Start and end are code points, the end exclusive.  A null text counts as
    empty: no spans.  Each row is judged by itself, so repeated rows and very long
    texts need no care; a column of the name ``out`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)
    return append_struct(docs, text, out, FOUND, lambda: lambda texts: scan(texts, shipped.value, sure))
