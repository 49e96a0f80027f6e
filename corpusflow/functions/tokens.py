"""Tokens for the index, for rule scores and for query terms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, and stop words of the n-gram index.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
STOP_WORDS = ("一个", "一些", "以及", "中的", "为了", "关于", "分析", "研究", "领域", "应用")
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def index_tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case and without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN), F.lit(INDEX_TOKEN), 0)


def grams(run: Column, low: int, high: int) -> Column:
    """All n-grams of one run of characters, the short ones first."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(low), F.lit(high)),
            lambda n: F.when(
                F.length(run) >= n,
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )


def cjk_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[一-鿿]+"), 0)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.flatten(F.transform(runs, lambda r: grams(r, low, high))), lambda g: ~F.array_contains(stop, g))


def index_text(*parts: Column) -> Column:
    """The parts that are not blank, a line each, then their CJK n-grams."""
    raw = F.array_join(F.filter(F.array(*parts), lambda p: F.trim(p) != ""), "\n")
    found = cjk_grams(raw)
    return F.when(F.size(found) > 0, F.concat(raw, F.lit("\n"), F.array_join(found, " "))).otherwise(raw)


def query_terms(c: Column, most: int = 32) -> Column:
    """ASCII words as written, then CJK n-grams; each once, ``most`` at most."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9_+\-./]{1,}"), 0)
    return F.slice(F.array_distinct(F.concat(words, cjk_grams(c))), 1, most)


def phrase_terms(c: Column, most: int = 32) -> Column:
    """The query terms as the index knows them: a term of several index tokens is a phrase, with a blank between each two."""
    phrases = F.transform(query_terms(c, most), lambda t: F.array_join(index_tokens(t), " "))
    return F.array_distinct(F.filter(phrases, lambda p: p != ""))


def rule_tokens(c: Column) -> Column:
    """The token set of the rule score: words in lower case, CJK runs of up to 8 and their 2- and 3-grams."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9][a-z0-9._/-]{1,}"), 0)
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[一-鿿]+"), 0)
    short = F.filter(runs, lambda r: F.length(r) <= 8)
    return F.array_distinct(F.concat(words, short, F.flatten(F.transform(runs, lambda r: grams(r, 2, 3)))))


def rule_phrases(c: Column, most: int = 8) -> Column:
    """CJK runs, then words, of four characters or more."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[一-鿿]+"), 0)
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9][a-z0-9._/-]{1,}"), 0)
    return F.slice(F.filter(F.concat(runs, words), lambda p: F.length(p) >= 4), 1, most)


def overlap(asked: Column, held: Column) -> Column:
    """The share of the asked tokens that are held."""
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, held)) / F.size(asked).cast("double"))


def phrase_share(phrases: Column, text: Column) -> Column:
    hit = F.size(F.filter(phrases, lambda p: F.lower(F.coalesce(text, F.lit(""))).contains(p)))
    return F.when(F.size(phrases) == 0, F.lit(0.0)).otherwise(hit / F.size(phrases).cast("double"))
