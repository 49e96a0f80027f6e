"""Helpers that several operators share: materialised tables, seeds, span strings."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.

    The lineage ends at the files, which every executor can read, so the loss of
    an executor costs a reread and never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def spans_string(spans: list, order: dict) -> str:
    """``kind:start:end`` of each span, by start, then by the listed order of kinds."""
    ranked = sorted(set(spans), key=lambda s: (s[1], order.get(s[0], len(order)), s[0], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ranked)


def append_struct(df: DataFrame, text: str, out: str, kind: T.StructType, prepare, rows: int = 1000) -> DataFrame:
    """``df`` and one struct column ``out``, made from the column ``text``.

    ``prepare()`` runs once in each task and returns a function from a list of
    texts to a list of dicts.  At most ``rows`` rows are held at a time.  A column
    of the name ``out`` is replaced; all others pass through as they are.
    """
    kept = [c for c in df.columns if c != out]
    arrow = to_arrow_type(kind)

    def run(batches):
        work = prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = pa.array(work(part.column(text).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], [*kept, out])

    source = df if out not in df.columns or out == text else df.drop(out)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, kind)])
    return source.mapInArrow(run, schema)
