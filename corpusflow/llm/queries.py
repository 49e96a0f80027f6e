"""The registered queries of the operators in this folder, and the SQL that checks them."""

import public_tokenizers
from pyspark.sql import functions as F

from . import common
from .bpe import decode, encode
from .credentials import find_credentials
from .decontaminate import decontaminate
from .html_text import html_to_text
from .language import held_out, identify
from .language import train as train_language
from .line_dedup import dedup_lines
from .near_dup import near_duplicates
from .packing import pack, tokenizer_json
from .pii import find_personal_data
from .pii import train as train_tagger
from .runs import find_runs
from .url_filter import judge_urls
from .vector_dedup import near_vectors
from .whitening import fit, whiten

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages").select("page_id", "html")
    return html_to_text(pages).select("page_id", F.col("rendered.content").alias("content"), F.col("rendered.n_blocks").alias("n_blocks"))


def op2_line_dedup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_removed")


def op3_near_dup(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_personal_data(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train_tagger(docs)).drop("text")
    return found.select("doc_id", *(F.col(f"found.{c}").alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")))


def op5_near_vectors(spark, sf_dir):
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


def op6_language(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = identify(docs.select("doc_id", "text"), train_language(docs)).drop("text")
    return told.select("doc_id", held_out().alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op7_packing(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_json(TOKENIZER))


def op8_decontaminate(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(F.col(f"found.{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op9_credentials(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_credentials(docs)
    return found.select("doc_id", *(F.col(f"found.{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")))


def op10_url_filter(spark, sf_dir):
    return judge_urls(common.table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_whitening(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    told = whiten(vectors, fit(vectors)).where("whitening is not null")
    each = told.select("vec_id", "whitening.n", "whitening.deviation", "whitening.identity_error", F.posexplode(F.arrays_zip("whitening.whitened", "whitening.explained")).alias("place", "c"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def with_periods(docs):
    """Documents of which every tenth, by a hash of its id, repeats a part of its words to its end."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    told = docs.withColumn("w", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10).cast("long")).withColumn("n", F.size("w"))
    told = told.withColumn("a", F.expr("cast(g % nullif(n, 0) as int)")).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return told.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark, sf_dir):
    found = find_runs(with_periods(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *(F.col(f"found.{c}").alias(c) for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")))


def op13_bpe(spark, sf_dir):
    vocabulary = tokenizer_json(TOKENIZER)
    there = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "encoded.ids", "encoded.n_tokens")
    back = decode(there, vocabulary)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded.text", 256).alias("decoded_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline  # noqa: F401  it belongs to this folder

    every = [op1_html_text, op2_line_dedup, op3_near_dup, op4_personal_data, op5_near_vectors, op6_language, op7_packing, op8_decontaminate, op9_credentials, op10_url_filter, op11_whitening, op12_word_runs, op13_bpe, pipeline]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict:
    return {}
