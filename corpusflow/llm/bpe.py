"""Operator 13: byte-pair encoding and decoding, exact, by dynamic programming over prefixes.

Every prefix of a piece of text has one encoding, so one last token, and the
encoding of the prefix before that token is the rest of it.  For each prefix the
suffix automaton of the vocabulary lists the tokens in which the prefix ends; the
last token is the one whose neighbour, the last token of the prefix before it, it
can stand next to: no merge joins them across their border.  The last token of
every prefix is stored, and back-pointers from the end give the ids.  Long pieces
cost time linear in their length times the tokens that end at a place.
"""

import json
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct
from .packing import PLAIN, SPLIT, byte_names, splits_as_known

ENCODED = T.StructType().add("ids", "binary").add("n_tokens", "long")
DECODED = T.StructType().add("text", "string")
NEVER, LAST = 1 << 60, 256


class SuffixAutomaton:
    """The suffixes of all words added: ``step`` by a symbol, ``link`` to the longest shorter suffix of another class."""

    def __init__(self):
        self.next, self.link, self.length, self.token = [{}], [-1], [0], [-1]

    def state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.token.append(-1)
        return len(self.next) - 1

    def split(self, p: int, symbol, q: int) -> int:
        """A state for the words of q up to one symbol after those of p; what led there from p's suffixes leads to it."""
        twin = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def extend(self, last: int, symbol) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self.split(last, symbol, q)
        new, p = self.state(self.length[last] + 1, {}, -1), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, symbol, q)
        return new

    def add(self, word, token: int) -> None:
        last = 0
        for symbol in word:
            last = self.extend(last, symbol)
        self.token[last] = token

    def shorter_tokens(self) -> list:
        """For each state the nearest one over its links whose longest word is a token; -1 where none is."""
        near = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            near[s] = up if self.token[up] >= 0 else near[up]
        return near


class Vocabulary:
    """Tokens, merges and the suffix automaton of one tokenizer file.

    Only files that split and normalize as ``packing.SPLIT`` says, mark the end of a
    piece with a suffix, number merged tokens in the order of their merges and have
    added tokens without white space are taken; any other is refused, as the
    method's exactness rests on these.
    """

    def __init__(self, tokenizer_json: str):
        d = json.loads(tokenizer_json)
        model, added = d["model"], d.get("added_tokens", [])
        ids, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [ids.get(a + b, -1) for a, b in merges]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        simple = all(not any(a[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(map(str.isspace, a["content"])) for a in added)
        ordered = all(x >= 0 for x in made) and all(x < y for x, y in zip(made, made[1:])) and all(ids[a] < m and ids[b] < m for (a, b), m in zip(merges, made))
        if not (model["type"] == "BPE" and plain and simple and ordered and model.get("end_of_word_suffix") and splits_as_known(tokenizer_json)):
            raise ValueError("the tokenizer is not of the kind whose prefixes have one encoding each")
        self.end = model["end_of_word_suffix"]
        self.own = {c: b for b, c in byte_names().items()}
        self.added = {a["content"]: a["id"] for a in added}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.merged = {(ids[a], ids[b]): m for (a, b), m in zip(merges, made)}
        self.halves = {m: pair for pair, m in self.merged.items()}
        self.automaton, self.size, self.edges = SuffixAutomaton(), {}, ({}, {})
        for token, i in sorted(ids.items(), key=lambda x: x[1]):
            if i not in self.halves or self.stands(*self.halves[i], i):
                symbols = self.symbols(token)
                self.size[i] = len(symbols)
                self.automaton.add(symbols, i)
        self.near = self.automaton.shorter_tokens()
        # the length at which a state's longest word, if it is a token, is matched whole
        self.whole = [n if t >= 0 else NEVER for n, t in zip(self.automaton.length, self.automaton.token)]

    def symbols(self, token: str) -> list:
        """The bytes of a token; the last one is 256 more where it ends a piece."""
        ends = token.endswith(self.end) and token != self.end
        codes = list(self.bytes_of(token[: -len(self.end)] if ends else token))
        return [*codes[:-1], codes[-1] + LAST] if ends else codes

    def bytes_of(self, named: str) -> bytes:
        return named.translate(self.own).encode("latin-1")

    def edge(self, token: int, side: int) -> list:
        """(token, when a merge takes it up) along one edge of a token's merges, from the first symbol to the whole."""
        known = self.edges[side].get(token)
        if known is None:
            half = self.halves.get(token)
            # what this token's half was until now the top of is taken up by this merge
            known = [*((t, min(until, token)) for t, until in self.edge(half[side], side)), (token, NEVER)] if half else [(token, NEVER)]
            self.edges[side][token] = known
        return known

    def stands(self, left: int, right: int, own: int = NEVER) -> bool:
        """Whether no merge before ``own`` joins the two over their border while both are being built.

        Merges happen in the order of their numbers, and of one number from the left,
        so a merge over the border needs a smaller number than the one that takes up
        the left part, and none larger than the one that takes up the right part.
        """
        lefts, rights = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            m = self.merged.get((a, b), NEVER)
            if m < min(a_until, own) and m <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1


class Encoder:
    """Ids of texts.  New pieces of a block of texts go through the dynamic program side by side, long ones each by itself."""

    def __init__(self, vocabulary: Vocabulary, tokenizer, room: int = 300_000, long: int = 48):
        import regex

        self.v, self.tokenizer, self.room, self.long = vocabulary, tokenizer, room, long
        self.words: dict = {}
        self.parts: dict = {}
        self.findall = regex.compile(SPLIT).findall
        marks = "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None
        a = vocabulary.automaton
        edges = np.array([(s << 9 | c, t) for s, step in enumerate(a.next) for c, t in step.items()], dtype=np.int64)
        self.edges, self.to = edges[edges[:, 0].argsort()].T.copy()
        self.link, self.length, self.token, self.near, self.whole = (np.array(x, dtype=np.int64) for x in (a.link, a.length, a.token, vocabulary.near, vocabulary.whole))
        self.size = np.zeros(max(vocabulary.size) + 1, dtype=np.int64)
        self.size[list(vocabulary.size)] = list(vocabulary.size.values())
        self.pairs, self.known = np.zeros(1, dtype=np.int64) - 1, np.zeros(1, dtype=bool)

    def piece(self, piece: bytes) -> list:
        """The ids of one piece."""
        a, near, whole = self.v.automaton, self.v.near, self.v.whole
        step, link, length, token = a.next, a.link, a.length, a.token
        state = matched = 0
        last, pairs = [], {}
        for i, symbol in enumerate([*piece[:-1], piece[-1] + LAST]):
            while symbol not in step[state]:
                state = link[state]
                matched = length[state]
            state, matched = step[state][symbol], matched + 1
            s = state if whole[state] <= matched else near[state]
            while (before := i - length[s]) >= 0:
                pair = last[before], token[s]
                if pair not in pairs:
                    pairs[pair] = self.v.stands(*pair)
                if pairs[pair]:
                    break
                s = near[s]
            last.append(token[s])
        ids, i = [], len(last) - 1
        while i >= 0:
            ids.append(last[i])
            i -= self.v.size[last[i]]
        return ids[::-1]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the symbols lead; -1 where they lead nowhere."""
        key = state << 9 | symbol
        at = np.searchsorted(self.edges, key).clip(0, len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.to[at], -1)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key).clip(0, len(self.pairs) - 1)
        new = np.unique(key[self.pairs[at] != key])
        if len(new):
            if len(self.pairs) > 4 * self.room:
                self.pairs, self.known, new = self.pairs[:0], self.known[:0], np.unique(key)
            pairs = np.append(self.pairs, new)
            known = np.append(self.known, [self.v.stands(k >> 32, k & (1 << 32) - 1) for k in new.tolist()])
            order = pairs.argsort()
            self.pairs, self.known = pairs[order], known[order]
            at = np.searchsorted(self.pairs, key)
        return self.known[at]

    def pieces(self, pieces: list) -> list:
        """The ids, as bytes, of each piece; all prefixes of one length are done at once."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        size, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
        codes = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        codes[begin + size - 1] += LAST
        last = np.zeros((len(pieces), int(size[0])), dtype=np.int64)
        state, matched = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        for i in range(int(size[0])):
            live = int(np.searchsorted(-size, -i, side="left"))
            symbol, here = codes[begin[:live] + i], state[:live]
            following = self.step(here, symbol)
            stuck = np.flatnonzero(following < 0)
            while len(stuck):
                here[stuck] = self.link[here[stuck]]
                matched[stuck] = self.length[here[stuck]]
                following[stuck] = self.step(here[stuck], symbol[stuck])
                stuck = stuck[following[stuck] < 0]
            state[:live] = following
            matched[:live] += 1
            s = np.where(self.whole[following] <= matched[:live], following, self.near[following])
            todo = np.arange(live)
            while len(todo):
                token, before = self.token[s[todo]], i - self.length[s[todo]]
                good = before < 0
                inner = np.flatnonzero(~good)
                good[inner] = self.fits(last[todo[inner], before[inner]], token[inner])
                last[todo[good], i] = token[good]
                todo = todo[~good]
                s[todo] = self.near[s[todo]]
        at, found = size - 1, []
        while len(rows := np.flatnonzero(at >= 0)):
            ids = last[rows, at[rows]]
            found.append((rows, ids))
            at[rows] -= self.size[ids]
        count = np.bincount(np.concatenate([r for r, _ in found]), minlength=len(pieces))
        end = np.cumsum(count)
        flat, place = np.zeros(int(end[-1]), dtype="<u4"), end - 1
        for rows, ids in found:
            flat[place[rows]] = ids
            place[rows] -= 1
        whole, out = flat.tobytes(), [b""] * len(pieces)
        for k, a, b in zip(order.tolist(), (4 * (end - count)).tolist(), (4 * end).tolist()):
            out[k] = whole[a:b]
        return out

    def split(self, word: str) -> list:
        """The pieces, as bytes, of a word; ids of added tokens stand between them.  What is not plain is normalized and split by the library."""
        if self.marks is not None and self.marks.search(word):
            return [y for x in self.marks.split(word) if x for y in ([self.v.added[x]] if x in self.v.added else self.split(x))]
        if PLAIN.fullmatch(word):
            low = word.lower()
            return [low.encode()] if low.isalpha() else [p.encode() for p in self.findall(low)]
        return [self.v.bytes_of(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]

    def texts(self, texts: list) -> list:
        """The ids, as bytes, of each text.  No token crosses white space, so they are those of its words one after the other."""
        if max(len(self.words), len(self.parts)) > self.room:
            self.words, self.parts = {}, {}
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words, parts = self.words, self.parts
        new = {w: self.split(w) for w in {w for each in split for w in each if w not in words}}
        missing = list({p for each in new.values() for p in each if not isinstance(p, int) and p not in parts})
        short = [p for p in missing if len(p) <= self.long]
        parts.update(zip(short, self.pieces(short)))
        parts.update((p, array("I", self.piece(p)).tobytes()) for p in missing if len(p) > self.long)
        for w, each in new.items():
            words[w] = b"".join([array("I", [p]).tobytes() if isinstance(p, int) else parts[p] for p in each])
        return [b"".join([words[w] for w in each]) for each in split]


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text", out: str = "encoded") -> DataFrame:
    """``docs`` and a struct ``out``: ids (little-endian unsigned 32-bit numbers) and n_tokens.

    A null or empty text has no ids.  Texts are encoded whole, whatever their length;
    strings of the added tokens give their ids.  A column of the name ``out`` is
    replaced, all others pass through; repeated rows give equal ids; an empty table
    stays empty.  The file travels as a broadcast of a fixed few MB, and each task
    builds the automaton from it once.
    """
    Vocabulary(tokenizer_json)  # refuses here what tasks would refuse
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def prepare():
        encoder = encoder_of(shipped.value)

        def work(texts):
            return [{"ids": x, "n_tokens": len(x) // 4} for x in encoder.texts(texts)]

        return work

    return append_struct(docs, text, out, ENCODED, prepare)


def encoder_of(tokenizer_json: str) -> Encoder:
    """One encoder for each worker and file: tasks that follow each other in a worker share it."""
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_corpusflow_encoders", type(sys)("_corpusflow_encoders")).__dict__
    key = str(hash(tokenizer_json))
    if key not in kept:
        kept[key] = Encoder(Vocabulary(tokenizer_json), Tokenizer.from_str(tokenizer_json))
    return kept[key]


def decode(encoded: DataFrame, tokenizer_json: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` and a struct ``out`` with the text of the binary column ``ids``, special tokens included.

    The file names no decoder, so a text is its tokens with a blank between them.
    Null or empty ids give an empty text; an id that the file does not know adds
    nothing.  Other columns pass through, one of the name ``out`` is replaced.
    """
    d = json.loads(tokenizer_json)
    if d.get("decoder") is not None:
        raise ValueError("the tokenizer has a decoder of its own")
    shipped = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in d["model"]["vocab"].items()} | {a["id"]: a["content"] for a in d.get("added_tokens", [])})

    def prepare():
        names = shipped.value

        def work(rows):
            return [{"text": " ".join([names[i] for i in np.frombuffer(r or b"", dtype="<u4").tolist() if i in names])} for r in rows]

        return work

    return append_struct(encoded, ids, out, DECODED, prepare)
