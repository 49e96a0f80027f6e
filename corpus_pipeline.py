"""A corpus pipeline of five stages; each works on all documents that the one before it kept.

``documents`` has the columns doc_id, text, lang, source and n_chars; others pass
through.  Every stage writes its result as Parquet, from which the next one reads.
SQL cannot express these stages, so ORACLE_SQL is None and the tests hold each
stage against a plain version.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize
from corpusflow.llm.decontaminate import decontaminate
from corpusflow.llm.language import identify, train
from corpusflow.llm.line_dedup import dedup_lines
from corpusflow.llm.near_dup import near_duplicates
from corpusflow.llm.packing import pack, tokenizer_json

ORACLE_SQL = None
#: How far a score must be above that of a text which shares nothing with what was learned, and such a text.
LEAST_ABOVE, STRANGE = 0.002, "\ua66e" * 40
KEY = "text_key_of_near_dup"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def bound(spark: SparkSession, model) -> float:
    """The score under which a text is in no learned language: that of a text without any learned n-gram, and a little more."""
    return identify(spark.createDataFrame([(STRANGE,)], "text string"), model, out="told").first()["told"]["score"] + LEAST_ABOVE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: no letter (``und``), or a score that is not above ``bound``.

    So texts of other scripts and noise without a learned n-gram go, and short or mixed
    texts of the learned languages stay.  A null text goes.  Rows are
    judged one by one, so repeated rows share their fate; an empty table stays empty.
    """
    model = train(docs)
    told = identify(docs, model, out="language_")
    return told.where((F.col("language_.lang_pred") != "und") & (F.col("language_.score") > bound(spark, model))).drop("language_")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; a text of which nothing is left goes, and n_chars follows the text.

    Null and empty texts stay; rows equal in id and text are one document.
    """
    left = dedup_lines(docs, out="n_removed_").where("n_removed_ = 0 or trim(BOTH ' \\n\\t' FROM text) <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed_") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without an id stay.

    Near are documents of a similarity of 0.8 or more.  Documents are told apart by id
    and text: different texts under one id are judged each by itself, of rows equal in
    both one stays.  Texts that are null, empty or without words link with nothing and
    all stay.
    """
    named = docs.withColumn(KEY, F.xxhash64("text"))
    told = materialize(near_duplicates(docs, percent=80).withColumnRenamed("text_key", KEY).where("group_key is not null"), "told")
    place = F.struct("doc_id", KEY)
    first = told.groupBy("group_key").agg(F.min(place).alias("first"))
    gone = told.join(first, "group_key").where(place != F.col("first")).select("doc_id", KEY).distinct()
    again = told.groupBy("doc_id", KEY).count().where("count > 1").select("doc_id", KEY)
    left = named.join(gone, ["doc_id", KEY], "left_anti")
    once = left.join(again, ["doc_id", KEY], "left_anti")
    several = left.join(again, ["doc_id", KEY], "left_semi").dropDuplicates(["doc_id", KEY])
    return once.unionByName(several).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go; null and empty texts hold none and stay, repeated rows share their fate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, out="found_").where("not found_.contaminated").drop("found_")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; a null or empty text is an end id alone, repeated rows repeat."""
    return pack(docs, tokenizer_json(TOKENIZER))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
