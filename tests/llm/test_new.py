"""Whitening, word runs and byte-pair encoding against plain versions and on edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import bpe, packing, queries, runs, whitening

VOCABULARY = packing.tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_str(VOCABULARY)
sha = lambda b: hashlib.sha256(b).hexdigest()


# whitening


def plain_whitening(e):
    x = np.floor(64 * np.asarray(e, dtype=float)).astype(np.int64) + 1_000_000
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    far = len(x) * x - x.sum(0)
    return values[::-1], vectors[:, ::-1], centred, (far * far).sum(1)


def check_whitening(e, got, want=32):
    values, vectors, centred, deviation = plain_whitening(e)
    assert {(r["vec_id"], r["component"]) for r in got} == {(i, c) for i in range(len(e)) for c in range(1, want + 1)}
    white = np.zeros((len(e), want))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(e) and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-10
    expected = centred @ vectors[:, :want] / np.sqrt(values[:want])
    expected *= np.sign((expected * white).sum(0))
    assert np.abs(expected - white).max() < 1e-7


def test_whitening_equals_the_dense_eigenvectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    check_whitening([r["embedding"] for r in rows], queries.op11_whitening(spark, sf).collect())


@pytest.mark.parametrize("dims,spectrum", [(96, "flat"), (120, "falling"), (40, "flat")])
def test_pairs_are_certified(dims, spectrum):
    rng = np.random.default_rng(dims)
    scale = np.ones(dims) if spectrum == "flat" else 0.8 ** np.arange(dims)
    x = rng.normal(size=(3000, dims)) * scale
    v = np.cov(x.T, bias=True)
    passes = []
    vectors, values = whitening.top_pairs(lambda b: passes.append(1) or v @ b, dims, 32, 16, 10, 40, 1)
    true, basis = np.linalg.eigh(v)
    assert np.allclose(values, true[::-1][:32], rtol=1e-12) and len(passes) < 150
    assert np.abs(np.abs((basis[:, ::-1][:, :32] * vectors).sum(0)) - 1).max() < 1e-12


def test_ties_of_eigenvalues_end():
    """Equal eigenvalues have no vectors of their own; any basis of their space will do."""
    v = np.diag([5.0] * 3 + [2.0] * 57)
    vectors, values = whitening.top_pairs(lambda b: v @ b, 60, 32, 16, 10, 6, 1)
    assert np.allclose(values, np.diag(v)[:32]) and np.allclose(v @ vectors, vectors * values) and np.allclose(vectors.T @ vectors, np.eye(32))


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(200, 5)).tolist()
    rows = [(k, x) for k, x in enumerate(e)] + [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1e300] * 5)]
    rows += [(1000 + k % 3, [float(k % 3), 1.0]) for k in range(9)] + [(2000, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("n", "part", "e", "whitening")})
    fitted = whitening.fit(df)
    assert sorted(fitted) == [2, 3, 5] and fitted[2].n == 9 and len(fitted[3].values) == 0 and len(fitted[2].values) == 1 and fitted[5].identity_error < 1e-10
    told = whitening.whiten(df, fitted)
    assert told.columns == ["vec_id", "embedding", "n", "part", "e", "whitening"] and told.count() == len(rows)
    got = {r["vec_id"]: r["whitening"] for r in told.collect()}
    assert all(got[k] is None for k in (900, 901, 902, 903, 904, 905, 2000)) and len(got[0]["whitened"]) == 5 and len(got[1001]["whitened"]) == 1
    values, vectors, centred, deviation = plain_whitening(e)
    assert [got[k]["deviation"] for k in range(200)] == deviation.tolist()
    assert whitening.whiten(df.limit(0), whitening.fit(df.limit(0))).count() == 0


def test_numbers_beyond_a_long():
    x = np.array([[2**51, -5], [7, 2**40]])
    sums = [int(v) for v in x.astype(object).sum(0) * 2000]
    far = whitening.from_mean(x, 4000, sums)
    assert [[int(v) for v in row] for row in far] == [[4000 * int(v) - s for v, s in zip(row, sums)] for row in x]
    assert whitening.squares(far)[0] is None and whitening.squares(np.array([[3, -4]])) == [25]


# word runs


def plain_runs(words):
    """Every lag and every stretch of it, by the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        t = 0
        while t + q < n:
            if words[t] != words[t + q]:
                t += 1
                continue
            s = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            if t + q - s >= max(6, 4 * q):
                found.setdefault((s, t + q - s), q)
    return sorted((s, n_, q) for (s, n_), q in found.items())


def plain_row(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return {
        "n_runs": len(found), "start": top[0], "length": top[1], "period": top[2], "exponent_milli": 1000 * top[1] // top[2] if found else None,
        "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()),
    }


def random_texts(rng, count):
    for _ in range(count):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        words = []
        while len(words) < rng.randint(0, 120):
            root = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            words += root * rng.choice([1, 1, 2, 4, 5, 7]) + root[: rng.randint(0, len(root))]
        yield " ".join(words)


def test_runs_equal_the_definition():
    rng = random.Random(12)
    texts = list(random_texts(rng, 1500)) + [" ".join("ab"[bin(k).count("1") % 2] for k in range(300)), "x " * 1000, "a b " * 300 + "a", "", None]
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 400:
        fib.append(f"{fib[-1]} {fib[-2]}")
    texts.append(fib[-1])
    for at in range(0, len(texts), 97):
        part = texts[at : at + 97]
        for text, got in zip(part, runs.find_all(part)):
            assert {k: got[k] for k in plain_row("")} == plain_row(text), text


def test_the_grammar_gives_the_words_back_and_shares_rules():
    rng = random.Random(5)
    words = np.array([rng.randrange(4) for _ in range(3000)] + list(range(10)) * 100)
    part = np.repeat([0, 1, 2], [1000, 1000, 2000])
    g = runs.Grammar(words, part)

    def expand(symbol):
        k = symbol - g.base
        return [symbol] if k < 0 else expand(g.left[k]) + expand(g.right[k])

    assert [w for root in g.roots for w in expand(root)] == words.tolist() and g.places.tolist() == [0, 1000, 2000]
    assert len(g.left) < 0.55 * len(words)
    assert len(runs.Grammar(np.tile(np.arange(50), 64), np.zeros(3200, int)).left) < 120


def test_runs_of_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in queries.op12_word_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for i, text in texts.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if n > 2500:
            continue  # the plain version is quadratic
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        row = got[i]
        row.pop("doc_id")
        assert row == plain_row(" ".join(words)), i
    assert planted and any(r["n_runs"] for r in got.values())


def test_runs_edges(spark):
    rows = [(1, "a b " * 9, 1), (1, "a b " * 9, 1), (2, None, 2), (3, "", 3), (4, " \t\n", 4), (5, "very long " * 60_000, 5), (6, "one word " * 7, 6), (None, "x " * 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").withColumns({c: F.lit("mine") for c in ("found", "w", "g", "n")})
    out = runs.find_runs(df)
    assert out.columns == ["doc_id", "text", "start", "w", "g", "n", "found"]
    got = [(r["doc_id"], r["found"]) for r in out.collect()]
    assert [f["collapsed"] for i, f in got if i == 1] == ["a b", "a b"]
    by = dict(got)
    assert by[2]["n_runs"] == by[3]["n_runs"] == by[4]["n_runs"] == 0 and by[2]["start"] is None and by[2]["collapsed_sha256"] == sha(b"")
    assert (by[5]["length"], by[5]["period"], by[5]["collapsed"]) == (120_000, 2, "very long") and (by[6]["length"], by[None]["length"]) == (7, 6)
    assert runs.find_runs(df.limit(0)).count() == 0
    assert queries.with_periods(df).count() == len(rows)


# byte-pair encoding

TEXTS = [
    None, "", " \n ", "Hello world", "it's we'll don't 'sss ''s", "café café Ångström ẞ İstanbul", "中文　字 \U0001F600\U0001F468‍\U0001F469 �\u0000x",
    "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>c <|end", "x" * 5000, "ab" * 3000, "12345 3.14 $%^&*() __init__ a1b2", "́  x y\u0085z   \x1c\x1d", "</w> w</w>x <w>", "한국어 हिन्दी ไทย",
]


def library_row(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


def test_encoding_equals_the_library(spark):
    rng = random.Random(13)
    letters = "abcdeinorst'éß 1-́中\U0001F600\n<|>"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"encoded": F.lit(1), "decoded": F.lit(1), "ids": F.lit(2)})
    out = bpe.encode(df.drop("ids"), VOCABULARY)
    assert out.columns == ["doc_id", "text", "decoded", "encoded"]
    back = bpe.decode(out.select("doc_id", "text", "encoded.ids", "encoded.n_tokens"), VOCABULARY)
    for r in back.collect():
        ids, decoded = library_row(r["text"])
        assert (bytes(r["ids"]), r["n_tokens"], r["decoded"]["text"]) == (ids, len(ids) // 4, decoded), r["text"]
    assert bpe.encode(df.limit(0), VOCABULARY).count() == 0


def test_every_token_alone_and_beside_another():
    """Tokens and pairs of tokens, as plain pieces, against the library's own model."""
    encoder = bpe.Encoder(bpe.Vocabulary(VOCABULARY), LIBRARY)
    rng = random.Random(14)
    names = [t for t in LIBRARY.get_vocab() if not t.startswith("<|") and t != "</w>"]
    plain = [t.removesuffix("</w>") for t in names]
    pieces = list({*rng.sample(plain, 3000), *(rng.choice(plain) + rng.choice(plain) + rng.choice(plain) for _ in range(6000))})
    raw = [encoder.v.bytes_of(p) for p in pieces]
    for piece, one, ids in zip(pieces, raw, encoder.pieces(raw)):
        want = [t.id for t in LIBRARY.model.tokenize(piece)]
        assert encoder.piece(one) == want == np.frombuffer(ids, "<u4").tolist(), piece


def test_automaton_lists_the_suffixes_that_are_tokens():
    words = ["a", "ab", "b", "bab", "abab", "aba", "c"]
    automaton = bpe.SuffixAutomaton()
    for k, w in enumerate(words):
        automaton.add(w, k)
    near = automaton.shorter_tokens()
    rng = random.Random(15)
    text = "".join(rng.choice("abc") for _ in range(400))
    state = matched = 0
    for i, c in enumerate(text):
        while state and c not in automaton.next[state]:
            state = automaton.link[state]
            matched = automaton.length[state]
        state, matched = automaton.next[state][c], matched + 1
        s = state if automaton.token[state] >= 0 and automaton.length[state] <= matched else near[state]
        got = []
        while s >= 0:
            got.append(words[automaton.token[s]])
            s = near[s]
        assert got == sorted((w for w in words if text[: i + 1].endswith(w)), key=len, reverse=True)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(packing.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))


def test_encoding_of_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = library_row(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha(ids), sha(decoded.encode()))
