"""Hybrid retrieval for a batch of queries: two recalls, fusion, reranking, evidence."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import FIELD_WEIGHTS, Retrieval
from ..functions.tokens import phrase_terms
from ..operators.bm25 import bm25, top
from ..operators.evidence import keep_useful, local_first, merge_adjacent
from ..operators.fusion import fuse
from ..operators.rerank import rerank
from ..operators.vectors import nearest


#: Fixed value: the candidates of up to so many questions are broadcast.
FEW_QUESTIONS = 10_000


def keyword_recall(chunks: DataFrame, queries: DataFrame, fields: dict | None = None, allowed: Column | None = None, conf: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, id, rank) by weighted BM25; ``chunks`` has id and the fields, ``queries`` query_id and text.

    A term like ``gpt-4`` is a phrase: its tokens must stand side by side.
    """
    terms = queries.select("query_id", F.explode(phrase_terms(F.col("text"))).alias("term"))
    scored = bm25(chunks, fields or {k: w for k, w in FIELD_WEIGHTS.items() if k in chunks.columns}, terms, allowed, conf, phrases=True)
    return top(scored, conf.recall_k, F.round("score", 9), F.col("id")).select("query_id", "id", "rank")


def vector_recall(vectors: DataFrame, queries: DataFrame, metric: str = "l2", conf: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, id, rank) by distance; ``vectors`` has id and v, ``queries`` query_id and q."""
    return top(nearest(vectors, queries, metric, conf.recall_k, first=True), conf.recall_k, F.round("distance", 9), F.col("id")).select("query_id", "id", "rank")


class Trace:
    """How many rows each stage of a plan gave, counted while the plan runs."""

    def __init__(self):
        self.stages: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        self.stages[name] = Observation(name)
        return df.observe(self.stages[name], F.count(F.lit(1)).alias("result_count"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(pos, stage, result_count), once an action has run the plan; waits for it."""
        return spark.createDataFrame([(k, n, o.get["result_count"]) for k, (n, o) in enumerate(self.stages.items())], "pos int, stage string, result_count long")


def hybrid(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, conf: Retrieval = Retrieval(), trace: Trace | None = None) -> DataFrame:
    """Reranked candidates of each question (query_id, text, q), with the attributes of their chunks.

    Only ids and ranks go through recall and fusion; attributes are joined to the few
    candidates that are left, which go to the chunks if there are few.  ``trace`` counts the rows of the stages.
    """
    watch = trace.watch if trace else lambda name, df: df
    lists = {
        "vector": watch("vector_recall", vector_recall(vectors, questions.select("query_id", "q"), conf=conf)),
        "keyword": watch("keyword_recall", keyword_recall(chunks, questions.select("query_id", "text"), conf=conf)),
    }
    fused = watch("hybrid_rrf", fuse(lists, conf.rrf_k, conf.fusion_limit))
    asked = questions.select("query_id", F.col("text").alias("query"))
    few = asked.limit(FEW_QUESTIONS + 1).count() <= FEW_QUESTIONS  # of each so many candidates as the fusion leaves
    ranked = fused.withColumnRenamed("rank", "recall_rank")
    wide = chunks.join(F.broadcast(ranked) if few else ranked, "id").join(asked, "query_id")
    return watch("local_retrieval", rerank(wide.where(F.col("recall_rank") < conf.rerank_documents), conf.final_limit))


def answer_context(candidates: DataFrame, verdicts: DataFrame | None, external: DataFrame, conf: Retrieval = Retrieval()) -> DataFrame:
    """Evidence for each question: useful chunks merged with their neighbours, local before external, up to the limit.

    ``external``: query_id, id, order.
    """
    judged = candidates.withColumn("verdict", F.lit(None).cast("string")) if verdicts is None else candidates.join(verdicts, ["query_id", "document_id"], "left")
    rows = keep_useful(judged).select(
        "query_id", "document_id", "chunk_index", F.col("rerank_rank").alias("order"), "chunk_text", F.col("rerank_score").alias("score"), F.col("recall_rank").alias("rank")
    )
    merged = merge_adjacent(rows)
    local = merged.select("query_id", F.col("document_id").alias("id"), F.col("first_order").alias("order"))
    return local_first(local, external, conf.final_limit)
