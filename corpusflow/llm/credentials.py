"""Operator 9: secrets, with weak candidates reported only where complementary parts meet.

The base kinds are reported wherever they stand.  Weaker parts (short keys, user
names, connection addresses) say little alone.  Parts of one text are joined on
their intervals: two parts meet if the text between them is at most ``reach``
characters and holds no blank line, which ends a scope.  A weak secret is reported
if it meets an identifier or an endpoint, a weak identifier or an endpoint if it
meets a secret.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct, spans_string

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "identifier": 3, "secret": 4, "endpoint": 5}
#: Weak parts: what they are, and a text that must occur before the expression is tried.
WEAK = [
    ("identifier", ("KIA", "SIA", "ROA", "IDA"), re.compile(r"(?<![A-Z0-9])A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{6,}")),
    ("identifier", ("=", ":"), re.compile(r"""(?<![A-Za-z])(?:client_?id|account_?id|user_?name|user|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)),
    ("secret", ("=", ":"), re.compile(r"""(?<![A-Za-z])(?:pwd|pass|credential|auth|private_?key|signature)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A)),
    ("secret", ("",), re.compile(r"(?<![0-9a-f])[0-9a-f]{20,31}(?![0-9a-zA-Z])")),
    ("endpoint", ("://",), re.compile(r"(?<![a-z])(?:https?|ftp|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s\"'<>]{4,}")),
    ("endpoint", ("=", ":"), re.compile(r"""(?<![A-Za-z])(?:host|server|endpoint|base_?url)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?""", re.I | re.A)),
]
ROLE = {"assign": "secret", "hex": "secret", "access": "identifier"}
MEETS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    + [T.StructField("parts", T.ArrayType(SPAN)), T.StructField("n_linked", T.LongType())]
)


def base_spans(text: str) -> list:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def weak_parts(text: str, base: list) -> list:
    """Weak parts that overlap no base span; of those that overlap each other the first, and the longest of equals."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reached = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    found = set()
    for kind, needs, pattern in WEAK:
        if any(n in text for n in needs):
            for m in pattern.finditer(text):
                a, b = m.span()
                k = bisect_left(starts, b)
                if not k or reached[k - 1] <= a:
                    found.add((kind, a, b))
    parts: list = []
    for part in sorted(found, key=lambda s: (s[1], -s[2], ORDER[s[0]])):
        if not parts or part[1] >= parts[-1][2]:
            parts.append(part)
    return parts


def linked(text: str, base: list, weak: list, reach: int) -> list:
    """The weak parts that meet a complementary part within their scope.

    Scopes are numbered by the blank lines before them.  For each role the nearest
    part on either side is enough: if that one is too far or in another scope, so
    is every other on its side.  Nearest before is the one that ends last, as parts
    may lie inside each other.
    """
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    by_role: dict = {"secret": [], "identifier": [], "endpoint": []}
    for kind, a, b in base + weak:
        by_role[ROLE.get(kind, kind)].append((a, b))
    lookup = {}
    for role, parts in by_role.items():
        parts.sort()
        lookup[role] = [a for a, _ in parts], list(accumulate((b for _, b in parts), max))

    def near(left, right):
        return right - left <= reach and bisect_left(breaks, right) == bisect_right(breaks, min(left, right) - 1)

    def meets(a, b, role):
        starts, reached = lookup[role]
        at = bisect_left(starts, b)
        before = bisect_left(starts, a)
        # parts of a role never hold a weak part of another role, so those that start inside it meet it
        if before < at:
            return True
        return (before > 0 and near(min(a, reached[before - 1]), a)) or (at < len(starts) and near(b, starts[at]))

    return [(kind, a, b) for kind, a, b in weak if any(meets(a, b, role) for role in MEETS[kind])]


def scan(text: str | None, reach: int) -> dict:
    text = text or ""
    base = base_spans(text)
    more = linked(text, base, weak_parts(text, base), reach)
    count = {k: sum(s[0] == k for s in base) for k in ("assign", "access", "hex")}
    every = sorted(base + more, key=lambda s: (s[1], ORDER[s[0]]))
    return {
        **{f"n_{k}": n for k, n in count.items()},
        "base_sha256": hashlib.sha256(spans_string(base, ORDER).encode()).hexdigest(),
        "spans": spans_string(every, ORDER),
        "parts": [{"kind": k, "start": a, "end": b} for k, a, b in every],
        "n_linked": len(more),
    }


def find_credentials(docs: DataFrame, reach: int = 200, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` and one struct column ``out``: counts and digest of base spans, and all spans.

    Start and end are code points, the end exclusive.  A null text counts as
    empty: no spans.  Each row is judged by itself, so repeated rows and frequent
    keys need no care; a column of the name ``out`` is replaced.
    """
    return append_struct(docs, text, out, FOUND, lambda: lambda texts: [scan(t, reach) for t in texts])
