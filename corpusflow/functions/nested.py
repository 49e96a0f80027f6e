"""JSON of unknown shape, as VARIANT: read tolerantly, also where it was encoded twice."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_in(c: Column) -> Column:
    """The value of a JSON text; a text inside that is itself an array or an object is read again.

    Null if it begins with no JSON value; what follows the value is not read.
    """
    once = F.try_parse_json(c)
    inner = F.try_variant_get(once, "$", "string")
    again = F.when(F.schema_of_variant(once) == "STRING", F.when(F.trim(inner).rlike(r"^[\[{]"), F.try_parse_json(F.trim(inner))))
    return F.coalesce(again, once)


def text_at(v: Column, path: str, default: str = "") -> Column:
    """The text at a path; the default for what is missing, null or empty."""
    return F.coalesce(F.nullif(F.try_variant_get(v, path, "string"), F.lit("")), F.lit(default))


def number_at(v: Column, path: str) -> Column:
    """A finite number at a path: as it is, as a text, 0 for null and an empty text, 0 or 1 for a truth value; null for all else."""
    here = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(here)
    text = F.trim(F.try_variant_get(here, "$", "string"))
    found = F.when(kind == "VOID", 0.0).when(kind == "BOOLEAN", F.try_variant_get(here, "$", "boolean").cast("double")).when((kind == "STRING") & (text == ""), 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def items_at(v: Column, path: str) -> Column:
    """The items of the array at a path; none where there is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def object_at(v: Column, path: str) -> Column:
    """The object at a path as JSON text; an empty one for all else."""
    here = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(here).startswith("OBJECT"), F.to_json(here)).otherwise(F.lit("{}"))


def stripped(value):
    """The value without the members, at any depth, whose name begins with an underscore."""
    done: list = [None]
    todo = [(done, 0, value)]
    while todo:
        out, at, v = todo.pop()
        if isinstance(v, dict):
            kept = {k: x for k, x in v.items() if not k.startswith("_")}
            out[at] = dict.fromkeys(kept)
            todo.extend((out[at], k, x) for k, x in kept.items())
        elif isinstance(v, list):
            out[at] = [None] * len(v)
            todo.extend((out[at], k, x) for k, x in enumerate(v))
        else:
            out[at] = v
    return done[0]


def without_private(c: Column) -> Column:
    """JSON texts without private members, their names in order; what is no JSON is null."""

    def one(text):
        try:
            return None if text is None else json.dumps(stripped(json.loads(text)), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return clean(c)
