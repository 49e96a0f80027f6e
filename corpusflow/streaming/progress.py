"""The same counters and folds over a stream of events."""

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive as files; event time is a timestamp with time zone, as watermarks ask."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def source_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 0).alias("with_value"))


def windowed_counts(events: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events of a type in each window; late ones beyond the delay are not counted."""
    windows = events.withWatermark("at", delay).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Activity of a user without a longer gap than ``gap``."""
    sessions = events.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


FOLD_OUT = "step_id string, status string, n_updates long, last_seq long"
FOLD_STATE = "status string, n_updates long, last_seq long"


def folded_steps(events: DataFrame) -> DataFrame:
    """``events`` (step_id, seq, status): the newest state of each step, kept between batches; a null status changes nothing."""

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, count, last = state.get if state.exists else (None, 0, -1)
        for frame in frames:
            count += len(frame)
            known = frame[frame["status"].notna()]
            if len(known) and int(known["seq"].max()) >= last:
                newest = known.loc[known["seq"].idxmax()]
                status, last = newest["status"], int(newest["seq"])
        state.update((status, int(count), int(last)))
        yield pd.DataFrame({"step_id": [key[0]], "status": [status], "n_updates": [count], "last_seq": [last]})

    return events.groupBy("step_id").applyInPandasWithState(fold, FOLD_OUT, FOLD_STATE, "update", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there now, through the stream, as Parquet files in the shared folder; state lies beside them.

    Every micro-batch is a folder of its own, so one that is done again replaces
    itself.  In the mode ``complete`` the last one is the result, else all are.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}{uuid.uuid4().hex}"
    batches: list = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch-{batch}")
        batches.append(f"{folder}/rows/batch-{batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(batches[-1:] if mode == "complete" else batches)) if batches else empty


def each_batch(stream: DataFrame, checkpoint: str, action, mode: str = "append") -> None:
    """Run ``action(rows, batch id)`` for each micro-batch; with the checkpoint a batch that was done is not done again."""
    query = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


@contextlib.contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as state of several variables asks."""
    key, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
