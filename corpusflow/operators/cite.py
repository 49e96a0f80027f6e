"""Binding source tags of answers to numbered references, and finding the document of a reference."""

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tag of sources in an answer, one source inside it, and the line that opens the list of references.
TAG = r"\[\s*((?:@?(?:doc|ext)_[A-Za-z0-9_.-]+)(?:\s*[,;，；、]\s*@?(?:doc|ext)_[A-Za-z0-9_.-]+)*)\s*\]"
SOURCE = r"(?:doc|ext)_[A-Za-z0-9_.-]+"
HEADING = r"(?i)^(?:参考文献|references)\s*[:：]?$"


def without_references(body: Column) -> Column:
    """The text before the first line that says only that references follow; blanks at the ends go."""
    lines = F.split(F.coalesce(body, F.lit("")), r"\r\n|\n|\r")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x, F.lit(" \t")).rlike(HEADING)), True)
    return F.regexp_replace(F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n")).otherwise(F.coalesce(body, F.lit(""))), r"^\s+|\s+$", "")


def source_ids(body: Column) -> Column:
    """The source ids of all tags, in order."""
    return F.flatten(F.transform(F.regexp_extract_all(body, F.lit(TAG), 0), lambda t: F.regexp_extract_all(t, F.lit(SOURCE), 0)))


def numbered(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, source_id, number): numbers from 1 by first appearance; ids without a document have none.

    ``answers`` (answer_id, body), ``documents`` (answer_id, source_id, ...).  A list of
    references that an answer brings along is not read.
    """
    tags = answers.select("answer_id", F.posexplode(source_ids(without_references(F.col("body")))).alias("pos", "source_id"))
    first = tags.join(documents.select("answer_id", "source_id").distinct(), ["answer_id", "source_id"]).groupBy("answer_id", "source_id").agg(F.min("pos").alias("pos"))
    return first.select("answer_id", "source_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")).cast("long").alias("number"))


def render(answers: DataFrame, bound: DataFrame, references: DataFrame) -> DataFrame:
    """Answers with numbers for tags, and the list of references behind them; a list of their own goes.

    ``references`` (answer_id, source_id, citation).
    """
    listed = F.array_sort(F.collect_list(F.struct("number", "source_id", "citation")))
    lists = bound.join(references, ["answer_id", "source_id"]).groupBy("answer_id").agg(listed.alias("refs"))
    joined = answers.withColumn("body", without_references(F.col("body"))).join(lists, "answer_id", "left").withColumn("tags", F.array_distinct(F.regexp_extract_all("body", F.lit(TAG), 0)))
    number_of = F.coalesce(F.map_from_entries(F.transform("refs", lambda r: F.struct(r["source_id"], r["number"]))), F.expr("cast(map() as map<string,bigint>)"))

    def replacement(tag: Column) -> Column:
        numbers = F.filter(F.transform(F.regexp_extract_all(tag, F.lit(SOURCE), 0), lambda s: F.try_element_at(F.col("numbers"), s)), lambda n: n.isNotNull())
        return F.when(F.size(numbers) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ","), F.lit("]")))

    body = F.aggregate("tags", F.col("body"), lambda text, tag: F.replace(text, tag, replacement(tag)))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    lines = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("["), r["number"].cast("string"), F.lit("] "), r["citation"])), "\n")
    out = joined.withColumn("numbers", number_of).withColumn("plain", tidy)
    return out.select("answer_id", F.when(F.col("refs").isNull(), F.col("plain")).otherwise(F.concat("plain", F.lit("\n\n参考文献\n"), lines)).alias("answer"))


def match_text(c: Column) -> Column:
    """Lower case without bracketed numbers, addresses, blanks and punctuation."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\[[^\]]+\]", "")
    low = F.regexp_replace(F.regexp_replace(low, r"https?://[^\s]+", ""), r"\s+", "")
    return F.regexp_replace(low, r"""[.,;:!?()\[\]{}"'`~@#$%^&*_+=<>/\\|，。；：！？（）【】《》“”‘’、-]""", "")


def doi_key(c: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"10\.\d{4,9}/[-._;()/:a-z0-9]+", 0)
    return F.regexp_replace(found, r"""[.,;:!?()\[\]{}"'`]+$""", "")


def match_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """The document of each reference: by DOI, else by its citation, else by its title; the first in ``pos`` of equals.

    ``references`` (answer_id, ref, text) meet the documents of their own answer only:
    ``documents`` (answer_id, document_id, pos, doi, citation, title).
    """
    refs = references.select("answer_id", "ref", match_text(F.col("text")).alias("r"), doi_key(F.col("text")).alias("rd"))
    docs = documents.select("answer_id", "document_id", "pos", doi_key(F.col("doi")).alias("dd"), match_text(F.col("citation")).alias("c"), match_text(F.col("title")).alias("t"))
    inside = lambda x: (x != "") & (F.col("r").contains(x) | x.contains(F.col("r")))
    tier = F.when((F.col("rd") != "") & (F.col("rd") == F.col("dd")), 1).when(inside(F.col("c")), 2).when(inside(F.col("t")), 3)
    both = refs.join(docs, "answer_id").withColumn("tier", tier).where("tier is not null")
    return both.groupBy("answer_id", "ref").agg(F.min_by("document_id", F.struct("tier", "pos")).alias("document_id"), F.min("tier").alias("tier"))


def fuzzy_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """The most similar title of ``right`` (ref, title) for each of ``left`` (id, title), at ``least`` or above.

    Each different title is looked at once: one that ``right`` holds as well is matched by equality, which no
    other title can beat, and only the rest meets candidates that share its first two words or its first
    twelve characters.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x: str, y: str) -> float:
            m = difflib.SequenceMatcher(None, x, y)
            return m.ratio() if m.quick_ratio() >= least else 0.0  # never below the ratio

        return pd.Series([of(x, y) for x, y in zip(a, b)], dtype="float64")

    def blocks_of(column: str) -> Column:
        return F.array_distinct(F.array(F.substring_index(F.col(column), " ", 2), F.substring(F.col(column), 1, 12)))

    def titles(df: DataFrame, name: str) -> DataFrame:
        plain = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
        return df.select(F.col(df.columns[0]).alias(name), plain.alias(f"{name}_t")).where(F.col(f"{name}_t") != "")

    a, b = titles(left, "id"), titles(right, "ref").groupBy("ref_t").agg(F.min("ref").alias("ref"))
    met = a.select("id_t").distinct().join(b, F.col("id_t") == F.col("ref_t"), "left")
    equal = met.where("ref is not null").select("id_t", "ref", F.lit(1.0).alias("ratio"))
    rest = met.where("ref is null").select("id_t").withColumn("block", F.explode(blocks_of("id_t")))
    near = F.least(F.length("id_t"), F.length("ref_t")) * 2.0 >= least * (F.length("id_t") + F.length("ref_t"))
    pairs = rest.join(b.withColumn("block", F.explode(blocks_of("ref_t"))), "block").where(near).select("id_t", "ref", "ref_t")
    # few bytes and much work: as many tasks as are set, where adaptive execution would make one of them
    pairs = pairs.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id_t", "ref_t").distinct()
    scored = pairs.withColumn("ratio", ratio("id_t", "ref_t")).select("id_t", "ref", "ratio").union(equal).where(F.col("ratio") >= least)
    best = scored.groupBy("id_t").agg(F.min_by(F.struct("ref", "ratio"), F.struct(-F.col("ratio"), F.col("ref"))).alias("best")).select("id_t", "best.*")
    return a.join(best, "id_t").groupBy("id").agg(F.min_by("ref", F.struct(-F.col("ratio"), F.col("ref"))).alias("ref"), F.max("ratio").alias("ratio"))


def enrich(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry values before a record's own, but the record's own title, authors and abstract first.

    Joined on the normal form of the DOI; a record without a match keeps its values.
    """
    wins = ("year", "venue", "publisher", "volume", "issue", "pages", "url")
    keeps = ("title", "abstract")
    reg = registry.select(doi_key(F.col("doi")).alias("k"), *(F.col(c).alias(f"r_{c}") for c in wins + keeps)).dropDuplicates(["k"])
    joined = records.withColumn("k", doi_key(F.col("doi"))).join(reg.where("k <> ''"), "k", "left")
    own = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c), F.lit(""))
    values = {c: own(f"r_{c}", c) for c in wins} | {c: own(c, f"r_{c}") for c in keeps}
    matched = F.col("r_title").isNotNull()
    sources = F.when(matched, F.array_union(F.coalesce("metadata_sources", F.array()), F.array(F.lit("crossref")))).otherwise(F.col("metadata_sources"))
    return joined.select("id", "doi", *(v.alias(c) for c, v in values.items()), sources.alias("metadata_sources"), matched.alias("matched"))


#: The registry's types of works by their code; all other types are of code Z.
REGISTRY_TYPES = {
    "J": "journal-article journal journal-volume journal-issue", "C": "proceedings-article proceedings proceedings-series", "M": "book book-chapter book-section book-part book-series book-set book-track monograph reference-book edited-book",
    "D": "dissertation", "R": "report report-series", "S": "standard standard-series", "DB": "dataset", "EB/OL": "posted-content preprint",
}
ENRICHED = 10


def registry_code(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(*(F.when(low.isin(*names.split()), code) for code, names in REGISTRY_TYPES.items()), F.lit("Z"))


def may_enrich(position: Column, source_type: Column, source_id: Column, doi: Column, title: Column, include_local: bool = False) -> Column:
    """Whether a document is looked up in the registry: among the first ten, external (or local if asked for), with a DOI or a title."""
    kind, name = (F.lower(F.coalesce(c, F.lit(""))) for c in (source_type, source_id))
    whence = (kind == "external") | name.startswith("ext_")
    if include_local:
        whence = whence | kind.isin("local", "local_folder") | name.startswith("doc_")
    named = F.trim(F.concat(F.coalesce(doi, F.lit("")), F.coalesce(title, F.lit("")))) != ""
    return (position < ENRICHED) & whence & named


def reference_entries(answers: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, number, text, document_id): the entries under an answer, from the first of three sources that has any.

    ``answers`` (answer_id, role, content, pending), ``citations`` (answer_id, number, text,
    document_id), ``documents`` (answer_id, document_id, pos, doi, citation, title).  First the citations
    that are bound; else the numbered lines of the answer's own list, each with the document that it matches; else,
    unless the answer is still being written, its documents, each once.
    """
    shown = answers.where((F.col("role") == "assistant") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    bound = citations.join(shown.select("answer_id"), "answer_id", "left_semi").select("answer_id", "number", "text", "document_id")
    rest = shown.join(bound.select("answer_id").distinct(), "answer_id", "left_anti")
    lines = F.split("content", r"\r\n|\n|\r")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x, F.lit(" \t")).rlike(HEADING)), True)
    own = F.when(at > 0, F.slice(lines, (at + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    marked = rest.select("answer_id", F.explode(own).alias("line")).withColumn("number", F.regexp_extract("line", r"^\s*\[(\d{1,9})\]\s*\S", 1).try_cast("long")).where("number is not null")
    listed = marked.select("answer_id", "number", F.trim(F.regexp_replace("line", r"^\s*\[\d+\]", "")).alias("text"))
    first = Window.partitionBy("answer_id", "document_id").orderBy("pos")
    once = documents.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    matched = match_references(listed.select("answer_id", F.col("number").alias("ref"), "text"), once)
    parsed = listed.join(matched.select("answer_id", F.col("ref").alias("number"), "document_id"), ["answer_id", "number"], "left")
    left = rest.where(~F.col("pending")).join(listed.select("answer_id").distinct(), "answer_id", "left_anti").select("answer_id")
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")).cast("long")
    text = F.coalesce(F.nullif(F.col("citation"), F.lit("")), F.col("title"))
    plain = once.join(left, "answer_id", "left_semi").select("answer_id", place.alias("number"), text.alias("text"), "document_id")
    return bound.unionByName(parsed.select(*bound.columns)).unionByName(plain)
