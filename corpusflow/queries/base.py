"""Registration, table access and derived tables that both engines read."""

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name, with its SQL if SQL can express it."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


class Made:
    """A table made of given ones by a statement that both engines read; ``@name`` stands for a table."""

    def __init__(self, statement: str):
        self.statement = statement

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = self.statement
        for name in set(re.findall(r"@(\w+)", text)):
            view = f"{name}_{zlib.crc32(sf_dir.encode())}"
            table(spark, sf_dir, name).createOrReplaceTempView(view)
            text = re.sub(f"@{name}\\b", view, text)
        return spark.sql(text)

    @property
    def sql(self) -> str:
        return f"({self.statement.replace('@', '')})"


class Texts:
    """``documents`` as texts with something put around them: (id, s).

    Each form is (before, whether the document's text follows, after); a document
    takes one by its id, and ``#`` in a form stands for the id.  None is a null.
    """

    def __init__(self, forms: list):
        self.forms = forms

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("doc_id")
        filled = lambda x: F.replace(F.lit(x), F.lit("#"), key.cast("string"))
        made = F.lit(None).cast("string")
        for k, form in enumerate(self.forms):
            if form is not None:
                before, held, after = form
                made = F.when(key % len(self.forms) == k, F.concat(filled(before), F.coalesce("text", F.lit("")) if held else F.lit(""), filled(after))).otherwise(made)
        return table(spark, sf_dir, "documents").select(key.alias("id"), made.alias("s"))

    @property
    def sql(self) -> str:
        filled = lambda x: f"replace({literal(x)}, '#', CAST(doc_id AS VARCHAR))"
        cases = " ".join(f"WHEN {k} THEN {filled(f[0])} || {'coalesce(text, '+chr(39)*2+')' if f[1] else chr(39)*2} || {filled(f[2])}" for k, f in enumerate(self.forms) if f is not None)
        return f"(SELECT doc_id AS id, CASE doc_id % {len(self.forms)} {cases} END AS s FROM documents)"
