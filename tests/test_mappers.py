"""Numbering with constraints, greedy deduplication in rounds, nested JSON, traces of retrieval."""

import json
import random

from pyspark.sql import functions as F

from corpusflow.functions import nested
from corpusflow.operators import catalog as ct
from corpusflow.operators import federate as fd


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"n{k * 7919 % 1000:04d}", None if k % 50 == 0 else k % 3) for k in range(1000)], "name string, kind long").repartition(7)
    got = {r["name"]: r["n"] for r in ct.numbered(rows, ["name"], "n").collect()}
    assert got == {f"n{k:04d}": k + 1 for k in range(1000)}
    both = ct.numbered(rows, ["kind", "name"], "n").orderBy("n").collect()
    assert [r["n"] for r in both] == list(range(1, 1001)) and [(r["kind"] is not None, r["kind"] or 0, r["name"]) for r in both] == sorted((r["kind"] is not None, r["kind"] or 0, r["name"]) for r in both)
    assert ct.numbered(rows.limit(0), ["name"], "n").count() == 0


def test_inserts_see_no_single_task(spark):
    base = spark.createDataFrame([(5, "a")], "id long, name string")
    plan = ct.insert(base, spark.createDataFrame([("b",), ("c",)], "name string"), "id", ["name"])
    assert "Window" not in plan._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in plan.collect()) == [(5, "a"), (6, "b"), (7, "c")]


def test_constraints(spark):
    base = spark.createDataFrame([(1, "Taken", 1)], "id long, name string, parent long")
    rows = spark.createDataFrame([(" taken", 1, 1), ("new", 9, 2), ("new", None, 3), ("NEW ", 1, 4), (None, 1, 5), (" ", 1, 6)], "name string, parent long, pos long")
    after, rejected = ct.insert_checked(base.withColumn("pos", F.lit(0).cast("long")), rows, "id", ["pos"], ["name"], ["name"], [("parent", base, "id")])
    assert sorted((r["id"], r["name"]) for r in after.collect()) == [(1, "Taken"), (2, "new")]
    assert sorted((r["pos"], r["reason"]) for r in rejected.collect()) == [(1, "name is taken"), (2, "parent refers to nothing"), (4, "name is taken"), (5, "name is required"), (6, "name is required")]


def test_greedy_deduplication_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(g, p, [f"k{rng.randrange(60)}" for _ in range(rng.randint(0, 3))]) for g in range(3) for p in range(60)] + [(9, k, [f"c{k}", f"c{k + 1}"]) for k in range(12)]
    want = []
    for g in {r[0] for r in rows}:
        seen = set()
        for _, p, keys in sorted(r for r in rows if r[0] == g):
            if keys and seen.isdisjoint(keys):
                seen.update(keys)
                want.append((g, p))
    df = spark.createDataFrame(rows, "g long, p long, keys array<string>")
    assert sorted((r["g"], r["p"]) for r in fd.keep_first_by_keys(df, "g", "p").collect()) == sorted(want)
    assert fd.keep_first_by_keys(df.limit(0), "g", "p").count() == 0


def test_nested_values(spark):
    rows = [('{"a": "x", "n": "2.5", "e": "", "t": true, "z": null, "o": {"i": 1}, "l": [1, "b"]}',), (json.dumps('{"a": "twice"}'),), ('"[text"',), ("[",), (None,)]
    v = nested.variant_in(F.col("s"))
    got = spark.createDataFrame(rows, "s string").select(
        nested.text_at(v, "$.a", "-").alias("a"), nested.number_at(v, "$.n").alias("n"), nested.number_at(v, "$.e").alias("e"), nested.number_at(v, "$.t").alias("t"), nested.number_at(v, "$.z").alias("z"),
        nested.number_at(v, "$.a").alias("bad"), nested.object_at(v, "$.o").alias("o"), nested.object_at(v, "$.l").alias("l"), F.size(nested.items_at(v, "$.l")).alias("k"),
    ).collect()
    assert tuple(got[0]) == ("x", 2.5, 0.0, 1.0, 0.0, None, '{"i":1}', "{}", 2)
    assert [r["a"] for r in got] == ["x", "twice", "-", "-", "-"] and got[3]["k"] == 0


def test_private_members_go_at_any_depth():
    deep = value = {}
    for _ in range(5000):
        value["a"] = {"_x": 1}
        value = value["a"]
    left, depth = nested.stripped(deep), 0
    while left:
        assert list(left) == ["a"]
        left, depth = left["a"], depth + 1
    assert depth == 5000 and nested.stripped([{"_a": 1}, {"b": [{"_c": 2, "d": None}]}, "_e"]) == [{}, {"b": [{"d": None}]}, "_e"]
