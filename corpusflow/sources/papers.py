"""Paper records from catalogue files: Atom feeds, JSON works, JSON registry entries.

Fetching is a provider's matter; these readers take what was fetched.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

ENTRY = "id string, title string, summary string, published string, author array<struct<name: string>>, link array<struct<_href: string, _title: string, _type: string>>"
WORK = (
    "id string, doi string, title string, publication_year int, publication_date string, authorships array<struct<author: struct<display_name: string>>>, "
    "primary_location struct<source: struct<display_name: string>, landing_page_url: string, pdf_url: string>, abstract_inverted_index map<string, array<int>>, relevance_score double"
)
RECORD = ("source", "external_id", "title", "authors", "year", "venue", "doi", "url", "abstract", "pdf_url")


def empty(spark: SparkSession) -> DataFrame:
    """The result of a source that knows nothing."""
    return spark.createDataFrame([], ", ".join(f"{c} {'array<string>' if c == 'authors' else 'string'}" for c in RECORD))


def from_entries(entries: DataFrame) -> DataFrame:
    """Atom entries as records."""
    ident = F.regexp_extract("id", r"abs/([^/]+)$", 1)
    pdf = F.get(F.filter("link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), F.lit(0))["_href"]
    return entries.select(
        F.lit("arxiv").alias("source"), ident.alias("external_id"), tx.collapse(F.col("title")).alias("title"), F.transform("author", lambda a: tx.collapse(a["name"])).alias("authors"),
        F.substring("published", 1, 4).alias("year"), F.lit("arXiv").alias("venue"), F.lit("").alias("doi"), F.col("id").alias("url"), tx.collapse(F.col("summary")).alias("abstract"), F.coalesce(pdf, F.lit("")).alias("pdf_url"),
    ).where("title <> '' and external_id <> ''")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return from_entries(spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path))


def entries_of(feeds: DataFrame, column: str) -> DataFrame:
    """Entries of feeds held as texts."""
    parts = F.regexp_extract_all(F.col(column), F.lit("(?s)<entry>.*?</entry>"), 0)
    return feeds.select(F.explode(parts).alias("x")).select(F.from_xml("x", ENTRY).alias("e")).select("e.*")


def restore(words: Column) -> Column:
    """An abstract from a map of words to positions."""
    placed = F.flatten(F.transform(F.map_entries(words), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def from_works(works: DataFrame) -> DataFrame:
    """JSON works as records."""
    return works.select(
        F.lit("openalex").alias("source"), F.regexp_extract("id", r"([^/]+)$", 1).alias("external_id"), tx.collapse(F.col("title")).alias("title"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("publication_year").cast("string").alias("year"),
        F.coalesce("primary_location.source.display_name", F.lit("")).alias("venue"), F.regexp_replace(F.coalesce("doi", F.lit("")), "^https?://doi.org/", "").alias("doi"),
        F.coalesce("primary_location.landing_page_url", "id").alias("url"), restore(F.col("abstract_inverted_index")).alias("abstract"), F.coalesce("primary_location.pdf_url", F.lit("")).alias("pdf_url"),
    ).where("title <> '' and external_id <> ''")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return from_works(spark.read.schema(WORK).json(path))
