"""What a judge or a planner answers, as typed columns with safe values: coverage of evidence, and plans of a search.

Answers are JSON texts; an answer that is missing or is no JSON object takes the
values of a fallback made from what is known without it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.nested import items_at, text_at, variant_in

#: Words for truth values, names under which a query may come, and the most that may be asked for.
YES, NO = ("true", "yes", "1", "是", "需要"), ("false", "no", "0", "否", "不需要")
QUERY_NAMES = ("query", "queries", "keywords", "search_terms", "search_query")
FINAL_LIMIT, REQUEST_LIMIT = 10, 5


def kind_at(v: Column, path: str) -> Column:
    """BOOLEAN, STRING, ARRAY, OBJECT, VOID or a number's type; null where nothing is."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def truth_at(v: Column, path: str, default: bool) -> Column:
    """A truth value, or a word for one; the default for all else."""
    kind = kind_at(v, path)
    word = F.lower(F.trim(F.try_variant_get(v, path, "string")))
    said = F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    return F.coalesce(F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean")).when(kind == "STRING", said), F.lit(default))


def texts_at(v: Column, *paths: str) -> Column:
    """The distinct texts that are not blank at the first path that holds any: of an array, or one by itself."""
    lists = []
    for path in paths:
        one = F.array(F.try_variant_get(v, path, "string"))
        many = F.transform(items_at(v, path), lambda x: F.try_variant_get(x, "$", "string"))
        found = F.when(kind_at(v, path) == "STRING", one).when(kind_at(v, path) == "ARRAY", many).otherwise(F.array().cast("array<string>"))
        lists.append(F.array_distinct(F.filter(F.transform(F.array_compact(found), lambda t: F.trim(t)), lambda t: t != "")))
    out = lists[-1]
    for held in lists[-2::-1]:
        out = F.when(F.size(held) > 0, held).otherwise(out)
    return out


def whole_at(v: Column, path: str) -> Column:
    """A whole number, also from a text; null for all else."""
    return F.trim(F.try_variant_get(v, path, "string")).try_cast("int")


def within(c: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(c, F.lit(most)))


def coverage(answers: DataFrame) -> DataFrame:
    """``answers`` (query_id, answer, n_local, top_k) with what the judge found, or the fallback.

    A search outside is asked for exactly where the evidence is not sufficient; without
    an answer evidence is sufficient if there is any.
    """
    v = F.col("v_")
    told = answers.withColumn("v_", variant_in(F.col("answer"))).withColumn("ok_", F.coalesce(kind_at(v, "$") == "OBJECT", F.lit(False)))
    enough = F.when(F.col("ok_"), truth_at(v, "$.sufficient", False)).otherwise(F.col("n_local") > 0)
    told = told.withColumn("sufficient", enough).withColumn("reasons_", texts_at(v, "$.reason_codes"))
    missing = F.when(F.col("n_local") > 0, F.array(F.lit("llm_coverage_assessment_failed"))).otherwise(F.array(F.lit("llm_coverage_assessment_failed"), F.lit("no_local_evidence")))
    reasons = F.when(~F.col("ok_"), missing).when(~F.col("sufficient") & (F.size("reasons_") == 0), F.array(F.lit("llm_judged_insufficient"))).otherwise(F.col("reasons_"))
    default = F.greatest(F.col("top_k"), F.lit(FINAL_LIMIT))
    limit = F.when(F.col("sufficient"), 0).when(F.col("ok_"), within(F.coalesce(whole_at(v, "$.recommended_external_limit"), default), FINAL_LIMIT)).otherwise(FINAL_LIMIT)
    none = F.array().cast("array<string>")
    ids = lambda kind: F.when(F.col("ok_"), texts_at(v, f"$.{kind}_local_evidence_ids", f"$.{kind}_local_source_ids")).otherwise(none)
    return told.select(
        "query_id", "sufficient", (~F.col("sufficient")).alias("should_search_external"), reasons.alias("reason_codes"), limit.cast("int").alias("recommended_external_limit"), ids("useful").alias("useful_ids"), ids("discarded").alias("discarded_ids"),
        F.when(F.col("ok_"), truth_at(v, "$.freshness_gap_detected", False)).otherwise(False).alias("freshness_gap"), F.when(F.col("ok_"), F.trim(text_at(v, "$.rationale"))).otherwise("").alias("rationale"), F.when(F.col("ok_"), "llm").otherwise("fallback").alias("evaluator"),
    )


def query_words(v: Column) -> Column:
    """The query under the first of its names that is there: its items, or the phrases of one text."""
    out = F.array().cast("array<string>")
    for name in QUERY_NAMES[::-1]:
        listed = F.filter(F.transform(items_at(v, f"$.{name}"), lambda x: tx.collapse(F.try_variant_get(x, "$", "string"))), lambda t: t != "")
        here = F.when(kind_at(v, f"$.{name}") == "ARRAY", F.slice(F.array_distinct(listed), 1, 4)).otherwise(tx.query_keywords(F.try_variant_get(v, f"$.{name}", "string")))
        out = F.when(kind_at(v, f"$.{name}").isNotNull(), here).otherwise(out)
    return out


def one_plan(answers: DataFrame, this_year: int) -> DataFrame:
    """``answers`` (query_id, question, answer, fresh) with one search each: words, date_from, sort, order, limit, by_model.

    An answer without a query, or none at all, gives the plan of the question itself:
    its keywords, and the last two years by date where new work is asked for.
    """
    v = F.col("v_")
    told = answers.withColumn("v_", variant_in(F.col("answer"))).withColumn("own_", F.coalesce(query_words(v), F.array().cast("array<string>")))
    by_model = F.size("own_") > 0
    recent = F.when(F.col("fresh"), F.lit(f"{this_year - 2}0101"))
    sort, order = F.trim(text_at(v, "$.sortby")), F.trim(text_at(v, "$.orderby"))
    usual = F.when(F.col("fresh"), "submittedDate").otherwise("relevance")
    return told.select(
        "query_id", F.when(by_model, F.col("own_")).otherwise(tx.fallback_keywords(F.col("question"))).alias("words"), F.coalesce(F.when(by_model, tx.day_number(F.try_variant_get(v, "$.date_from", "string"))), recent).alias("date_from"),
        F.when(by_model & sort.isin("relevance", "submittedDate"), sort).otherwise(usual).alias("sort"), F.when(by_model & order.isin("ascending", "descending"), order).otherwise("descending").alias("order"),
        F.when(by_model, within(F.coalesce(whole_at(v, "$.limit"), F.lit(REQUEST_LIMIT)), REQUEST_LIMIT)).otherwise(REQUEST_LIMIT).cast("int").alias("limit"), by_model.alias("by_model"),
    )
