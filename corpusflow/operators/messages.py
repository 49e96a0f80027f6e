"""Stored messages and traces as typed rows; whatever is missing or broken has a default."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import items_at, number_at, object_at, text_at, variant_in

#: The states of a step that are kept as they are.
STEP_STATES = ("running", "success", "error")


def step_of(s: Column) -> Column:
    source, query, status = text_at(s, "$.source", "arxiv"), text_at(s, "$.query"), text_at(s, "$.status")
    return F.struct(
        F.coalesce(F.nullif(text_at(s, "$.id"), F.lit("")), F.concat(source, F.lit("-"), query)).alias("id"), F.when(status.isin(*STEP_STATES), status).otherwise("success").alias("status"), source.alias("source"), query.alias("query"),
        text_at(s, "$.sort_by", "relevance").alias("sort_by"), text_at(s, "$.sort_order", "descending").alias("sort_order"), text_at(s, "$.request_url").alias("request_url"),
        F.try_variant_get(s, "$.result_count", "long").alias("result_count"), F.try_variant_get(s, "$.coverage_sufficient", "boolean").alias("coverage_sufficient"), text_at(s, "$.error").alias("error"),
    )


def span_of(s: Column) -> Column:
    name = text_at(s, "$.name")
    return F.struct(
        F.coalesce(F.nullif(text_at(s, "$.span_id"), F.lit("")), name).alias("span_id"), F.when(name == "", "agent_step").otherwise(name).alias("name"), text_at(s, "$.type", "orchestrator").alias("type"), text_at(s, "$.status", "success").alias("status"),
        number_at(s, "$.elapsed_ms").alias("elapsed_ms"), object_at(s, "$.input").alias("input"), object_at(s, "$.output").alias("output"), object_at(s, "$.metrics").alias("metrics"), text_at(s, "$.error").alias("error"),
    )


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))


def objects(items: Column) -> Column:
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def mapped_messages(messages: DataFrame, context: str = "retrieval_context_json") -> DataFrame:
    """``messages`` and what their stored context says: documents, memories, citations (arrays of JSON texts), preparation and trace.

    A context that is no JSON object counts as empty.  A trace without a preparation
    gives one without steps that took as long as the trace.
    """
    m = messages.withColumn("v_", variant_in(F.col(context)))
    v = F.col("v_")
    m = m.withColumns({c: F.transform(items_at(v, f"$.{c}"), lambda x: F.to_json(x)) for c in ("documents", "memories", "citations")})
    trace = F.struct(
        text_at(v, "$.agent_trace.trace_id").alias("trace_id"), text_at(v, "$.agent_trace.status", "success").alias("status"), text_at(v, "$.agent_trace.started_at").alias("started_at"),
        F.nullif(text_at(v, "$.agent_trace.finished_at"), F.lit("")).alias("finished_at"), number_at(v, "$.agent_trace.elapsed_ms").alias("elapsed_ms"), F.transform(objects(items_at(v, "$.agent_trace.spans")), span_of).alias("spans"),
    )
    m = m.withColumn("trace", F.when(is_object(v, "$.agent_trace"), trace))
    seconds = F.try_variant_get(v, "$.preparation.elapsed_seconds", "variant")
    counted = F.when(F.schema_of_variant(seconds).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(seconds, "$", "double"))
    own = F.struct(counted.alias("elapsed_seconds"), F.transform(objects(items_at(v, "$.preparation.steps")), step_of).alias("steps"))
    none = F.filter(own["steps"], lambda x: F.lit(False))
    made = F.struct((F.col("trace.elapsed_ms") / 1000).alias("elapsed_seconds"), none.alias("steps"))
    return m.withColumn("preparation", F.when(is_object(v, "$.preparation"), own).when(F.col("trace").isNotNull(), made)).drop("v_")
