"""Rule-based reranking by lexical and bibliographic features, with a slot for a model."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DOI, YEAR
from ..functions.tokens import overlap, phrase_share, rule_phrases, rule_tokens

#: Fixed weights of the score.
OVERLAP = {"title": 8.0, "abstract": 3.5, "chunk_text": 6.0, "venue": 2.5, "authors": 2.0, "citation": 2.0}
PHRASE = {"title": 5.0, "chunk_text": 3.5, "abstract": 2.0}


def rule_score(query: Column, recall_rank: Column) -> Column:
    """The score of a candidate with the columns of OVERLAP, authors_list, year, doi and chunk_index."""
    asked, phrases, low = rule_tokens(query), rule_phrases(query), F.lower(query)
    score = F.lit(0.0)
    for field, weight in OVERLAP.items():
        score = score + weight * overlap(asked, rule_tokens(F.col(field)))
    for field, weight in PHRASE.items():
        score = score + weight * phrase_share(phrases, F.col(field))
    years = F.regexp_extract_all(query, F.lit(YEAR), 1)
    asked_doi = F.lower(F.regexp_extract(query, DOI, 0))
    score = score + F.when((F.col("year") != "") & F.array_contains(years, F.col("year")), 5.0).otherwise(0.0)
    score = score + F.when((asked_doi != "") & F.lower(F.coalesce("doi", F.lit(""))).contains(asked_doi), 8.0).otherwise(0.0)
    score = score + F.when((F.coalesce("venue", F.lit("")) != "") & low.contains(F.lower("venue")), 3.5).otherwise(0.0)
    score = score + F.when(F.exists("authors_list", lambda a: (F.length(a) >= 2) & low.contains(F.lower(a))), 4.0).otherwise(0.0)
    score = score + 2.5 / (recall_rank + 1).cast("double")
    return score + F.when(F.col("chunk_index").isNotNull(), 1.0 / (F.col("chunk_index") + 2).cast("double")).otherwise(0.0)


def rerank(candidates: DataFrame, top_k: int, per_document: int | None = None, score: Column | None = None) -> DataFrame:
    """The best ``top_k`` of each query by rounded score, at most ``per_document`` of one document."""
    scored = candidates.withColumn("rerank_score", F.round(rule_score(F.col("query"), F.col("recall_rank")) if score is None else score, 4))
    order = [F.desc("rerank_score"), F.asc("recall_rank"), F.asc("chunk_index"), F.asc("document_id")]
    if per_document:
        own = Window.partitionBy("query_id", "document_id").orderBy(*order)
        scored = scored.withColumn("own_", F.row_number().over(own)).where(F.col("own_") <= per_document).drop("own_")
    ranked = scored.withColumn("rerank_rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long"))
    return ranked.where(F.col("rerank_rank") < top_k)


def rerank_with(candidates: DataFrame, top_k: int, provider: Callable[[DataFrame], DataFrame] | None, most_docs: int = 100) -> DataFrame:
    """Scores of a model where it gives any, the rule's for a query without.

    ``provider`` takes (query_id, query, document_id, chunk_index, text) and returns
    (query_id, document_id, chunk_index, score).  The result says which one was used.
    """
    if provider is None:
        return rerank(candidates, top_k).withColumns({"rerank_provider": F.lit("rule"), "rerank_fallback_used": F.lit(True)})
    first = candidates.where(F.col("recall_rank") < most_docs)
    told = provider(first.select("query_id", "query", "document_id", "chunk_index", F.substring("chunk_text", 1, 4000).alias("text")))
    joined = candidates.join(told.withColumnRenamed("score", "model_"), ["query_id", "document_id", "chunk_index"], "left")
    any_ = F.max("model_").over(Window.partitionBy("query_id")).isNotNull()
    rule = rule_score(F.col("query"), F.col("recall_rank"))
    chosen = joined.withColumn("model_used", any_).where("not model_used or model_ is not null")
    out = rerank(chosen, top_k, score=F.when(F.col("model_used"), F.col("model_")).otherwise(rule))
    return out.withColumns({"rerank_provider": F.when(F.col("model_used"), "model").otherwise("rule"), "rerank_fallback_used": ~F.col("model_used")}).drop("model_", "model_used")
