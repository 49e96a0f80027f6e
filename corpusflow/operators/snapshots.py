"""A folder of Parquet parts whose current state is named by numbered manifests.

A writer puts its parts into folders of their own and commits by adding the next
manifest, which only one writer can do.  Parts that no manifest names were never
committed and nobody reads them, so a write that fails leaves the state as it was.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer committed first; read the state again and retry."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop

    def at(self, *parts: str):
        return self.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def files(self):
        return self.at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list:
        folder = self.at("manifests")
        if not self.files.exists(folder):
            return []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in self.files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def read(self) -> tuple:
        """(number, state) of the last commit; (0, {}) before the first."""
        numbers = self.numbers()
        if not numbers:
            return 0, {}
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self.files.open(self.at("manifests", f"{numbers[-1]:08d}.json"))
        try:
            return numbers[-1], json.loads(text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` the one after ``number``; ``Conflict`` if another writer did so first."""
        draft = self.at("manifests", f".{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        stream.write(json.dumps(state).encode())
        stream.close()
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        context = self.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            # a rename without the option to overwrite fails where the name is taken
            context.rename(draft, self.at("manifests", f"{number + 1:08d}.json"), gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception as error:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"state {number + 1} of {self.path} is taken") from error
            raise

    def put(self, df: DataFrame, name: str, partitions: list | None = None) -> str:
        """Write a part and return its name, which a manifest may list."""
        part = f"{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partitions) if partitions else df.write
        writer.parquet(f"{self.path}/{part}")
        return part

    def get(self, part: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def vacuum(self, keep: set) -> int:
        """Delete parts that are not in ``keep``; how many went.  Only when no writer is at work."""
        gone = [f.getPath() for f in self.files.listStatus(self.at()) if f.getPath().getName() != "manifests" and f.getPath().getName() not in keep]
        for path in gone:
            self.files.delete(path, True)
        return len(gone)

    def drop(self) -> None:
        """Delete the folder with all its states; nothing happens where there is none."""
        self.files.delete(self.at(), True)
