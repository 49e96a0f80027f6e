"""Operator 10: allowing and blocking URLs by pattern rules, with Spark functions alone.

A rule is a regular expression with literal tokens (runs of letters and digits)
that every URL it fits must hold.  Each rule is filed under the rarest of them, by
the counts of tokens in the URLs at hand.  A URL's own tokens fetch the rules
filed under them, and only those run their regular expressions.
"""

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules of the contract: (verdict, host, start of path).  They fit the host and its subdomains.
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules of the method for other URLs: (verdict, tokens that must occur, expression for the lower-cased URL).
PATTERN_RULES = [
    ("block", ["spam"], r"^[^/]*://[^/?#]*\bspam[-.]"),
    ("block", ["cheap", "pills"], r"^[^/]*://[^/?#]*\bcheap-pills\b"),
    ("block", ["casino"], r"\bcasino\b"),
    ("block", ["viagra"], r"\bviagra\b"),
    ("block", ["porn"], r"\bporn\b"),
    ("block", ["xxx"], r"\bxxx\b"),
    ("block", ["doubleclick", "net"], r"^[^/]*://([^/?#]*\.)?doubleclick\.net(?=[:/?#]|$)"),
    ("block", ["wp", "login", "php"], r"/wp-login\.php(?=[?#]|$)"),
    ("block", ["cgi", "bin"], r"^[^/]*://[^/]*/cgi-bin/"),
    ("block", ["phpsessid"], r"[?&;]phpsessid="),
]
INDEX = "array<array<struct<token: string, id: int, verdict: string, name: string, size: int, own: boolean, pattern: string>>>"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0))


def host_rule(verdict: str, host: str, path: str) -> dict:
    """A rule on host and path.  Only a token that ends inside the rule is sure to be one of the URL's."""
    text = host + path
    sure = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", text)
    pattern = r"^(?:[^/]*\.)?" + re.sub(r"([^a-z0-9/])", r"\\\1", text)
    return {"verdict": verdict, "name": text, "size": len(text), "own": True, "pattern": pattern, "tokens": sure}


def pattern_rule(verdict: str, tokens: list, pattern: str) -> dict:
    return {"verdict": verdict, "name": pattern, "size": 0, "own": False, "pattern": pattern, "tokens": tokens}


def rule_index(urls: DataFrame, rules: list) -> tuple:
    """The rules in buckets by a hash of their rarest token, and rules without any token.

    The counts are one number for each token of a rule, from all URLs.
    """
    spark = urls.sparkSession
    known = sorted({t for r in rules for t in r["tokens"]})
    counts = {}
    if known:
        held = F.array_intersect(tokens_of(ascii_lower(F.col("url"))), F.array(*map(F.lit, known)))
        counts = {r[0]: r[1] for r in urls.select(F.explode(held).alias("t")).groupBy("t").count().collect()}
    size = max(1, 2 * len(rules))
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in known], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(size))).collect()} if known else {}
    buckets: list = [[] for _ in range(size)]
    anywhere = []
    for k, rule in enumerate(rules):
        row = {**{f: rule[f] for f in ("verdict", "name", "size", "own", "pattern")}, "id": k}
        if rule["tokens"]:
            token = min(rule["tokens"], key=lambda t: (counts.get(t, 0), t))
            buckets[hashed[token]].append({**row, "token": token})
        else:
            anywhere.append({**row, "token": None})
    return buckets, anywhere


def judge_urls(pages: DataFrame, host_rules: list | None = None, pattern_rules: list | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and the pattern that decided, one row for each row of ``pages``.

    Of the host rules that fit, the longest decides and ``rule`` names it.  With
    none, ``rule`` is null, any pattern rule that fits blocks (or allows, with no
    blocking one), and ``default`` holds for the rest: null and empty URLs and
    those without ``://`` have an empty host and path.  Every row is judged by
    itself, in a plan without exchange, so repeated rows and frequent hosts need
    no care.  Only page_id and url are read of ``pages``.  The index is one
    constant of the plan; its size is that of the rules.
    """
    rules = [host_rule(*r) for r in (HOST_RULES if host_rules is None else host_rules)]
    rules += [pattern_rule(*r) for r in (PATTERN_RULES if pattern_rules is None else pattern_rules)]
    buckets, anywhere = rule_index(pages.select("url"), rules)
    index = F.from_json(F.lit(json.dumps(buckets)), INDEX)
    rest = F.from_json(F.lit(json.dumps([anywhere])), INDEX)
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lowered = F.coalesce(ascii_lower(F.col("url")), F.lit(""))
    fetched = F.flatten(
        F.transform(
            tokens_of(lowered),
            lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(len(buckets))).cast("int")), lambda r: r["token"] == t),
        )
    )
    candidates = F.concat(fetched, F.get(rest, F.lit(0)))
    site = F.concat("host", "path")
    fits = F.filter("candidates", lambda r: F.when(r["own"], F.rlike(F.col("site"), r["pattern"])).otherwise(F.rlike(F.col("lowered"), r["pattern"])))
    ranked = F.transform(fits, lambda r: F.struct(r["own"].alias("own"), r["size"].alias("size"), (r["verdict"] == "block").alias("blocks"), (-r["id"]).alias("order"), r["name"].alias("name"), r["verdict"].alias("verdict")))
    best = F.array_max(ranked)
    return (
        parsed.withColumns({"lowered": lowered, "site": site})
        .withColumn("candidates", candidates)
        .withColumn("best", best)
        .select(
            "page_id", "host", "path",
            F.when(F.col("best.own"), F.col("best.name")).alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
            F.when(~F.col("best.own"), F.col("best.name")).alias("pattern"),
            F.size("candidates").alias("n_candidates"),
        )
    )
