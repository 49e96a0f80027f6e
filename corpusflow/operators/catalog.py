"""The operational tables as snapshots: each change takes a table and gives the next one.

Parquet has no MERGE, so inserts, updates and deletes are functions (base, change) ->
new base.  Keys are unique in a base; of a change with one key twice the later row
(by its order column) counts.
"""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def latest(change: DataFrame, keys: list, order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return change.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def upsert(base: DataFrame, change: DataFrame, keys: list) -> DataFrame:
    """Rows of ``change`` replace those with the same key; others are added."""
    return base.join(change, keys, "left_anti").unionByName(change.select(*base.columns))


def patch(base: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Columns of ``change`` that are not null replace those of the row with the same key."""
    fields = [c for c in change.columns if c != key]
    new = change.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    joined = base.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def set_where(base: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` and their numbers from 1 in the given order, counted in ranges.

    Rows are sorted into ranges and written with their place in their range; the sizes
    of the ranges, one number for each, say where a range begins.  No task sees all
    rows.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    placed = sorted_.withColumns({"part_": part, "place_": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)})
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = {r["part_"]: r["count"] for r in placed.groupBy("part_").count().collect()}
    begins, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        begins.append(total)
        total += sizes.get(k, 0)
    begin = F.get(F.array(*map(F.lit, begins)), F.col("part_")) if begins else F.lit(0)
    return placed.withColumn(name, (begin + F.col("place_") + 1).cast("long")).drop("part_", "place_")


def insert(base: DataFrame, rows: DataFrame, key: str, order: list) -> DataFrame:
    """New rows get the next numbers after the largest one, in the given order."""
    first = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("last_"))
    counted = numbered(rows, order, "n_").crossJoin(first)  # one row
    return base.unionByName(counted.withColumn(key, (F.col("last_") + F.col("n_")).cast("long")).select(*base.columns))


def insert_checked(base: DataFrame, rows: DataFrame, key: str, order: list, required: list = (), unique: list = (), foreign: list = ()) -> tuple:
    """(the next base, rejected rows with a reason): rows that break a constraint are not inserted, the others are numbered.

    ``required`` columns must not be blank; ``unique`` ones (texts, whatever their case)
    must be new in the base and the first in ``rows`` by ``order``; ``foreign``: (column, parents, their
    key), where a null refers to nothing.
    """
    low = lambda c: F.lower(F.trim(c))
    told = rows.withColumn("reason", F.lit(None).cast("string"))
    for c in required:
        told = told.withColumn("reason", F.coalesce("reason", F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{c} is required")))
    for c, parents, parent_key in foreign:
        known = parents.select(F.col(parent_key).alias(c), F.lit(True).alias("known_")).distinct()
        told = told.join(known, c, "left").withColumn("reason", F.coalesce("reason", F.when(F.col(c).isNotNull() & F.col("known_").isNull(), f"{c} refers to nothing"))).drop("known_")
    for c in unique:
        taken = base.select(low(c).alias("low_"), F.lit(True).alias("taken_")).distinct()
        w = Window.partitionBy("low_", F.col("reason").isNull()).orderBy(*order)
        told = told.withColumn("low_", low(c)).join(taken, "low_", "left").withColumn("n_", F.row_number().over(w))
        told = told.withColumn("reason", F.coalesce("reason", F.when(F.col("taken_") | (F.col("n_") > 1), f"{c} is taken"))).drop("low_", "taken_", "n_")
    return insert(base, told.where("reason is null").drop("reason"), key, order), told.where("reason is not null").select(*rows.columns, "reason")


def delete_cascade(tables: dict, links: list, root: str, doomed: DataFrame) -> dict:
    """``links``: (child, child key, parent, parent key), parents first.  ``doomed`` are root rows."""
    gone, out = {root: doomed}, dict(tables)
    out[root] = tables[root].join(doomed, doomed.columns, "left_anti")
    for child, child_key, parent, parent_key in links:
        keys = gone[parent].select(F.col(parent_key).alias(child_key)).distinct()
        gone[child] = tables[child].join(keys, child_key, "left_semi")
        out[child] = tables[child].join(keys, child_key, "left_anti")
    return out


def unreferenced(rows: DataFrame, key: str, referring: DataFrame, foreign: str) -> DataFrame:
    """Rows that may be deleted: nothing refers to them."""
    return rows.join(referring.select(F.col(foreign).alias(key)), key, "left_anti")


def with_counts(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str) -> DataFrame:
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias("n_"))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce("n_", F.lit(0))).drop("n_")


def layered(own: DataFrame, default: DataFrame, key: str) -> DataFrame:
    """A setting of one's own, where it is not blank, before the default one."""
    base = default.select(key, F.col("value").alias("base_"))
    return base.join(own, key, "full").select(key, F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.col("base_")).alias("value"))


def migrate(df: DataFrame, added: dict, renamed: dict | None = None) -> DataFrame:
    """A table with more columns: ``added`` maps a name to its default."""
    out = df.withColumnsRenamed(renamed or {})
    return out.withColumns({c: F.lit(v) for c, v in added.items() if c not in out.columns})


def classify_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """``files`` (path, content_hash) against ``stored`` (content_hash, status, n_chunks).

    The first path of a content counts, later ones are duplicates.  A stored content
    that is not indexed or has no chunks is repaired.
    """
    w = Window.partitionBy("content_hash").orderBy("path")
    known = stored.groupBy("content_hash").agg(F.max((F.col("status") == "indexed") & (F.col("n_chunks") > 0)).alias("healthy"))
    state = (
        F.when(F.col("healthy"), "duplicate").when(F.row_number().over(w) > 1, "duplicate").when(F.col("healthy").isNotNull(), "repair").otherwise("new")
    )
    return files.join(known, "content_hash", "left").withColumn("state", state).select("path", "content_hash", "state")


def job_summary(items: DataFrame) -> DataFrame:
    ok, known = F.col("status") == "saved", F.col("status") == "duplicate"
    return items.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("new"), F.count_if(known).alias("skipped"), F.count_if(~(ok | known)).alias("failed")
    )


def last_rows(messages: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return messages.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= n).drop("n_")


def recall_memories(memories: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Memories of a query's session and the global ones, by 10 * shared words + importance; only positive scores.

    ``memories``: memory_id, session_id (null: global), body, importance; ``queries``:
    query_id, session_id, text.  Global ones meet a query on the words they share; of
    those that share none only the ``limit`` most important can be among the first.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.replace(c, F.lit("\n"), F.lit(" "))), " "), lambda w: w != ""))
    body = memories.withColumn("words", words(F.col("body")))
    asked = queries.select("query_id", F.col("session_id").alias("asked_session"), words(F.col("text")).alias("asked"))
    own = body.where("session_id is not null").join(asked, F.col("session_id") == F.col("asked_session"))
    common = body.where("session_id is null")
    met = common.select("memory_id", F.explode("words").alias("w")).join(asked.select("query_id", F.explode("asked").alias("w")), "w").select("query_id", "memory_id").distinct()
    first = common.orderBy(F.desc("importance"), "memory_id").limit(limit).select("memory_id")
    met = met.union(asked.select("query_id").crossJoin(F.broadcast(first))).distinct()
    shared = met.join(common, "memory_id").join(asked, "query_id")
    both = reduce(DataFrame.unionByName, [shared, own]).withColumn("score", (F.size(F.array_intersect("words", "asked")) * 10 + F.col("importance")).cast("long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("session_id").isNotNull(), F.desc("importance"), F.asc("memory_id"))
    return both.where("score > 0").withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < limit).select("query_id", "memory_id", "score", "rank")


def where_given(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every value that is given; None asks for nothing."""
    for name, value in values.items():
        df = df if value is None else df.where(F.col(name) == F.lit(value))
    return df


def memories(df: DataFrame, scope: str | None = None, session_id: int | None = None) -> DataFrame:
    """``df`` (memory_id, scope, session_id, importance, created_at): what is asked for with its place, the most important and then the newest first, of equals the smallest id.

    Places are counted in ranges, so no task holds all rows.
    """
    found = where_given(df, scope=scope, session_id=session_id)
    told = found.withColumns({"down_": -F.col("importance"), "age_": -F.unix_micros(F.col("created_at").cast("timestamp"))})
    return numbered(told, ["down_", "age_", "memory_id"], "place").drop("down_", "age_")
