"""Field-weighted BM25 over a batch of queries.

Corpus statistics (number of rows, document frequencies, mean length) are those of
the whole table; a filter on rows acts after matching.  The terms of the queries
go to the exploded tokens, so only postings of asked terms are shuffled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.tokens import index_tokens


#: Fixed value: a batch of queries goes to the rows with up to so many terms; of more both sides are shuffled.
MOST_TERMS = 100_000


def shipped(rows: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """``rows`` marked for a broadcast if there are ``most`` at most, which is counted."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def postings(docs: DataFrame, fields: dict, terms: DataFrame, phrases: bool = False, allowed: Column | None = None) -> DataFrame:
    """(id, term, dl, allowed, f): the weighted count of each asked term in the fields of each row, and the row's tokens.

    With ``phrases`` a term may be several tokens with blanks between them; it counts
    where they stand side by side in one field.
    """

    def weigh(number: int, name: str, weight: float) -> Column:
        return F.transform(index_tokens(F.col(name)), lambda t, at: F.struct(t.alias("token"), F.lit(float(weight)).alias("w"), F.lit(number).alias("field"), at.alias("at")))

    weighted = F.concat(*(weigh(n, name, weight) for n, (name, weight) in enumerate(fields.items())))
    listed = docs.select("id", (F.lit(True) if allowed is None else allowed).alias("allowed"), weighted.alias("p"))
    # the outer form, for which Spark does not read the texts once more to leave out empty ones
    tokens = listed.select("id", F.size("p").alias("dl"), "allowed", F.explode_outer("p").alias("p")).select("id", "dl", "allowed", "p.*")
    asked = terms.select("term").distinct()
    row = ("id", "term", "dl", "allowed")
    if not phrases:
        return tokens.withColumnRenamed("token", "term").join(shipped(asked), "term").groupBy(*row).agg(F.sum("w").alias("f"))
    parts = F.split("term", " ")
    places = asked.select("term", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "token"))
    # a term of one token needs no place, so its rows are summed before the shuffle
    spot = lambda c: F.when(F.col("n") > 1, c)
    started = tokens.join(shipped(places), "token").groupBy(*row, "n", spot(F.col("field")).alias("field"), spot(F.col("at") - F.col("k")).alias("start"))
    whole = started.agg(F.count("*").alias("held"), F.sum("w").alias("all"), F.max("w").alias("w")).where("n = 1 or held = n")
    # dealt by id alone, so that what is summed for a row later needs no further shuffle
    return whole.repartition("id").groupBy(*row).agg(F.sum(F.when(F.col("n") == 1, F.col("all")).otherwise(F.col("w"))).alias("f"))


def bm25(docs: DataFrame, fields: dict, terms: DataFrame, allowed: Column | None = None, conf: Retrieval = Retrieval(), phrases: bool = False) -> DataFrame:
    """(query_id, id, score) of all rows that hold a term; a smaller score is better.

    ``docs`` has id and the fields, ``terms`` (query_id, term), of several tokens each if
    ``phrases``.  ``allowed`` limits the
    rows that are returned but not the statistics.
    """
    length = sum((F.size(index_tokens(F.col(name))) for name in fields), F.lit(0))
    corpus = docs.select(length.alias("dl")).agg(F.count("*").alias("rows"), F.avg("dl").alias("mean"))
    held = postings(docs, fields, terms, phrases, allowed)
    df = held.groupBy("term").agg(F.count("f").alias("df"))  # f is never null; read here, both uses of the postings share one shuffle
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.crossJoin(corpus).select("term", "mean", F.when(idf <= 0, F.lit(conf.least_idf)).otherwise(idf).alias("idf"))  # corpus is one row
    f, dl = F.col("f"), F.col("dl")
    part = F.col("idf") * f * (conf.k1 + 1) / (f + conf.k1 * (1 - conf.b + conf.b * dl / F.col("mean")))
    few = terms.select("term").distinct().limit(MOST_TERMS + 1).count() <= MOST_TERMS
    scored = held.join(F.broadcast(weight) if few else weight, "term").where("allowed").select("id", "term", part.alias("part"))
    return scored.join(shipped(terms), "term").groupBy("query_id", "id").agg((-F.sum("part")).alias("score"))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query, with a rank from 0."""
    ranked = scored.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long"))
    return ranked.where(F.col("rank") < k)


def phrase_rows(docs: DataFrame, field: str, phrase: str) -> DataFrame:
    """Rows whose tokens hold those of the phrase side by side."""
    spark = docs.sparkSession
    asked = spark.range(1).select(F.concat(F.lit(" "), F.array_join(index_tokens(F.lit(phrase)), " "), F.lit(" ")).alias("p")).first()[0]
    joined = F.concat(F.lit(" "), F.array_join(index_tokens(F.col(field)), " "), F.lit(" "))
    count = F.floor((F.length(joined) - F.length(F.replace(joined, F.lit(asked), F.lit(" ")))) / (len(asked) - 1)).cast("long")
    return docs.withColumn("n_phrase", count).where(joined.contains(asked))
