"""Collections of vectors with their metadata, filed by their nearest centroid.

A batch is written whole and then committed by the collection's manifest; a batch that
fails is in no manifest and nobody sees it.  Deletes are committed the same way, as
lists of the versions that are dead.  A search reads the cells nearest to its queries,
or all of them, which is exact.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import Snapshots
from .vectors import blocks_of, matrix, nearest


def vector_rows(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks as rows of a collection: texts that are not blank, with an id made of library, document and place, and ``embed``'s vectors.

    ``chunks`` (library_id, document_id, chunk_index, chunk_text, and the columns
    section_type, section_title, section_chunk_index, indexable where they are known);
    ``embed`` adds a column v to a table with chunk_text.  A document without any text
    has no rows.
    """
    defaults = {"section_type": F.lit(""), "section_title": F.lit(""), "section_chunk_index": F.col("chunk_index"), "indexable": F.lit(True)}
    full = chunks.withColumns({c: F.coalesce(F.col(c), d) if c in chunks.columns else d for c, d in defaults.items()})
    named = full.withColumn("chunk_text", F.trim(F.coalesce("chunk_text", F.lit("")))).where("chunk_text <> ''")
    name = F.concat(F.lit("library-"), "library_id", F.lit("-doc-"), "document_id", F.lit("-chunk-"), "chunk_index")
    return embed(named.withColumn("id", name)).withColumn("token_count", F.length("chunk_text")).drop("chunk_text")


@dataclass(frozen=True)
class Collection:
    """One collection in a folder.  ``metadata`` names the columns kept beside id and v."""

    spark: SparkSession
    path: str
    metadata: T.StructType
    id_type: T.DataType = T.StringType()

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.path)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", self.id_type), T.StructField("v", T.ArrayType(T.DoubleType())), *self.metadata, T.StructField("cell", T.IntegerType())])

    def create(self, vectors: DataFrame, cells: int | None = None, sample: int = 50_000, seed: int = 7) -> dict:
        """An empty collection, with centroids fitted on about ``sample`` of these vectors (v), those with the smallest hashes.

        There are as many cells as the square root of the vectors' number, unless stated.
        """
        usable = vectors.where(F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col("v").cast("array<double>").alias("v"))
        count = usable.count()
        limit = int((1 << 30) * min(1.0, sample / max(count, 1)))
        drawn = usable.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < limit)
        wanted = cells or max(1, int(count**0.5))
        centroids = []
        if count and wanted > 1:
            model = KMeans(k=wanted, seed=seed, maxIter=20).fit(drawn.select(array_to_vector("v").alias("features")))
            centroids = [c.tolist() for c in model.clusterCenters()]
        state = {"centroids": centroids, "batches": [], "dead": []}
        self.snapshots.commit(0, state)
        return state

    def celled(self, rows: DataFrame, centroids: list) -> DataFrame:
        """``rows`` with the number of their nearest centroid; rows that no centroid fits by its length are in cell 0."""
        shipped = self.spark.sparkContext.broadcast(np.array(centroids))
        names = [f.name for f in self.schema.fields if f.name != "cell"]

        def run(batches):
            c = shipped.value
            for batch in batches:
                cell = np.zeros(batch.num_rows, dtype=np.int32)
                if c.size:
                    for dims, (at, m) in matrix(batch.column("v")).items():
                        if dims == c.shape[1]:
                            cell[at] = ((c * c).sum(1)[None, :] - 2 * m @ c.T).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*names, "cell"])

        casted = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != "cell"))
        return casted.mapInArrow(run, self.schema)

    def live(self, state: dict | None = None) -> DataFrame:
        """The rows that are there, with the number of their batch."""
        state = self.snapshots.read()[1] if state is None else state
        own = T.StructType([*self.schema, T.StructField("batch", T.IntegerType(), False)])
        parts = [self.snapshots.get(b["part"], self.schema).withColumn("batch", F.lit(b["number"])) for b in state["batches"]]
        rows = reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], own)
        key = T.StructType([own["id"], T.StructField("batch", T.IntegerType())])
        dead = [self.snapshots.get(p, key) for p in state["dead"]]
        return rows.join(reduce(DataFrame.union, dead), ["id", "batch"], "left_anti") if dead else rows

    def add(self, rows: DataFrame) -> dict:
        """A batch of rows (id, v, metadata) in one commit; ids that are there already are replaced.

        A vector that is null, empty or holds a null fails the batch, which then leaves
        the collection as it was.
        """
        number, state = self.snapshots.read()
        bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull())
        checked = rows.withColumn("v", F.when(bad, F.raise_error("a row of the batch has no vector").cast(rows.schema["v"].dataType)).otherwise(F.col("v")))
        mine = max((b["number"] for b in state["batches"]), default=0) + 1
        part = self.snapshots.put(self.celled(checked, state["centroids"]).repartition("cell"), "batch", ["cell"])
        written = self.snapshots.get(part, self.schema).select("id").distinct()
        replaced = self.live(state).join(written, "id", "left_semi").select("id", "batch")
        return self.commit(number, state, {"number": mine, "part": part}, replaced)

    def delete(self, condition: Column) -> dict:
        """Rows for which ``condition`` on id and metadata is true go; none is no error."""
        number, state = self.snapshots.read()
        return self.commit(number, state, None, self.live(state).where(condition).select("id", "batch"))

    def commit(self, number: int, state: dict, batch: dict | None, doomed: DataFrame) -> dict:
        dead = self.snapshots.put(doomed, "dead")
        some = not self.snapshots.get(dead, doomed.schema).isEmpty()
        new = {"centroids": state["centroids"], "batches": [*state["batches"], *([batch] if batch else [])], "dead": [*state["dead"], *([dead] if some else [])]}
        self.snapshots.commit(number, new)
        return new

    def compact(self) -> dict:
        """Live rows in one batch, without dead ones."""
        number, state = self.snapshots.read()
        part = self.snapshots.put(self.live(state).drop("batch").repartition("cell"), "batch", ["cell"])
        new = {"centroids": state["centroids"], "batches": [{"number": 1, "part": part}], "dead": []}
        self.snapshots.commit(number, new)
        self.snapshots.vacuum({part})
        return new

    def drop(self) -> None:
        self.snapshots.drop()

    def search(self, queries: DataFrame, k: int, metric: str = "l2", probes: int | None = None, guard: Column | None = None, digits: int = 9) -> DataFrame:
        """(query_id, id, rank, distance): the first k of each query (query_id, q), by distance and id.

        With ``probes`` a query meets the rows of its that many nearest cells only, and
        only cells that some query asks for are read; without, all rows, which is exact.
        ``guard`` is a condition on the metadata that hits must meet, so that a row of another
        library is never among them.
        """
        _, state = self.snapshots.read()
        rows = self.live(state)
        if guard is not None:
            rows = rows.where(guard)
        asked, cells = queries.select("query_id", "q"), probes is not None and len(state["centroids"]) > 0
        if cells:
            centroids = self.spark.createDataFrame(list(enumerate(state["centroids"])), T.StructType().add("id", "integer").add("v", T.ArrayType(T.DoubleType())))
            met = nearest(centroids, asked, "l2", probes, first=True)
            first = F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, probes)
            asked = asked.join(met.groupBy("query_id").agg(F.transform(first, lambda x: x["id"]).alias("cells")), "query_id")
            # cells that are asked for: at most as many numbers as there are centroids
            wanted = [r[0] for r in asked.select(F.explode("cells")).distinct().collect()]
            rows = rows.where(F.col("cell").isin(wanted))
        found = nearest(rows.select("id", "v", "cell"), asked, metric, k, cells, digits, first=True)
        order = "row_number() over (partition by query_id order by round(distance, {}), id) - 1".format(digits)
        return found.withColumn("rank", F.expr(order).cast("long")).where(F.col("rank") < k).select("query_id", "id", "rank", "distance")


__all__ = ["Collection", "blocks_of", "vector_rows"]
