"""Pages, sections and chunks; the lines of documents stand for pages and sections."""

from pyspark.sql import functions as F

from ..operators import split as sp
from ..plans.sections import section_chunks, split_documents
from .base import Made, query, table

PAGE = """(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents)"""


def pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page").cast("long"))


SPANS = f"""SELECT id, page, text, CAST(coalesce(sum(len(text) + 2) OVER (PARTITION BY id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM {PAGE} WHERE trim(text) <> ''"""


@query("page_spans", f"SELECT id, page, start_char, start_char + len(text) AS end_char FROM ({SPANS})")
def page_spans(spark, sf_dir):
    return sp.page_spans(pages(spark, sf_dir)).select("id", "page", "start_char", "end_char")


@query(
    "page_batches",
    f"""SELECT id, batch, min(page) AS first_page, max(page) AS last_page, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM
(SELECT *, CAST((row_number() OVER (PARTITION BY id ORDER BY page) - 1) // 3 AS BIGINT) AS batch FROM ({SPANS})) GROUP BY id, batch""",
)
def page_batches(spark, sf_dir):
    return sp.page_batches(sp.page_spans(pages(spark, sf_dir)))


@query(
    "section_ends",
    f"""WITH s AS ({SPANS}), t AS (SELECT s.id, s.start_char, d.text FROM s JOIN documents d ON d.doc_id = s.id WHERE s.page % 3 = 0 AND s.start_char < len(d.text)),
e AS (SELECT *, coalesce(lead(start_char) OVER (PARTITION BY id ORDER BY start_char), len(text)) AS end_char FROM t)
SELECT id, start_char, CAST(end_char AS BIGINT) AS end_char, CAST(len(trim(substring(text, start_char + 1, end_char - start_char))) AS BIGINT) AS n FROM e""",
)
def section_ends(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text"))
    starts = sp.page_spans(pages(spark, sf_dir)).where("page % 3 = 0").select("id", "start_char")
    return sp.section_texts(starts, docs).select("id", "start_char", "end_char", F.length("section_text").cast("long").alias("n"))


SECTIONED = f"SELECT id, page AS pos, text, len(text) // 150 AS kind FROM {PAGE}"


def sectioned(spark, sf_dir):
    return pages(spark, sf_dir).select("id", F.col("page").alias("pos"), "text", F.floor(F.length("text") / 150).cast("long").alias("kind"))


@query(
    "section_merge",
    f"""WITH s AS ({SECTIONED}), m AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS starts FROM s),
r AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT id, kind, min(pos) AS pos, count(*) AS n_merged, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM r GROUP BY id, run, kind""",
)
def section_merge(spark, sf_dir):
    return sp.merge_sections(sectioned(spark, sf_dir), ["kind"]).drop("run")


@query("section_renumber", f"SELECT id, pos, kind, row_number() OVER (PARTITION BY id, kind ORDER BY pos) - 1 AS section_chunk_index FROM ({SECTIONED})")
def section_renumber(spark, sf_dir):
    rows = sectioned(spark, sf_dir).withColumns({"section_type": F.col("kind"), "section_title": F.lit("")})
    return sp.renumber(rows).select("id", "pos", "kind", "section_chunk_index")


@query("size_bounded_merge")
def size_bounded_merge(spark, sf_dir):
    """Sequential within a document, so SQL has no plain form; tests hold it against a loop."""
    rows = sectioned(spark, sf_dir).select("id", "pos", F.col("kind").cast("string").alias("section"), "text")
    return sp.merge_short(rows, 600, ["section"])


def detect_by_rule(batches):
    """Sections for the tests: pages of 60 characters or more begin one, named by its first three words; long ones are not indexed, a few anchors are captions."""
    page = F.filter(F.split("text", "\n\n"), lambda p: F.length(p) >= 60)
    start = lambda p, n: F.array_join(F.slice(F.split(F.trim(p), r"\s+", n + 1), 1, n), " ")
    kind = lambda p: F.when(F.length(p) % 5 == 0, F.lit(None)).when(F.length(p) < 200, "introduction").otherwise("method")
    told = F.transform(page, lambda p: F.struct(kind(p).alias("section_type"), start(p, 3).alias("title"), F.when(F.length(p) % 7 == 0, "Table 1").otherwise(start(p, 6)).alias("start_anchor"), F.when(F.length(p) % 4 == 0, "No").otherwise("yes").alias("indexable")))
    return batches.withColumn("sections", told)


@query("section_pipeline")
def section_pipeline(spark, sf_dir):
    """Pages to batches, sections, chunks; the tests hold it against a loop over each document."""
    return section_chunks(pages(spark, sf_dir), detect_by_rule, 400)


@query("split_dispatch")
def split_dispatch(spark, sf_dir):
    """Documents of one language along their sections, all others by separators."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("lang") == "en", "semantic").otherwise("recursive").alias("chunk_mode"))
    return split_documents(docs, pages(spark, sf_dir), detect_by_rule, 400)


@query("recursive_split")
def recursive_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sp.recursive_split(docs, 512)


ANCHORS = Made(
    """SELECT doc_id AS id, text, CASE doc_id % 6 WHEN 0 THEN substring(text, 31, 25) WHEN 1 THEN translate(replace(trim(substring(text, 8, 20)), ' ', '   '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN substring(text, 11, 32) || ' OTHER ENDING' WHEN 3 THEN 'absent ' || doc_id WHEN 4 THEN ' ' ELSE substring(text, 2, 7) END AS anchor,
CASE WHEN doc_id % 7 < 3 THEN 5 ELSE 0 END AS start FROM @documents"""
)
SPECIAL = "'([\\\\.\\[\\]{}()*+?^$|])', '\\\\\\1', 'g'"


@query(
    "anchor_locate",
    f"""SELECT id, CASE WHEN a = '' THEN -1 WHEN instr(r, a) > 0 THEN instr(r, a) - 1 + start ELSE CASE WHEN w > 0 THEN w - 1 + start WHEN f > 0 THEN f - 1 + start ELSE -1 END END AS at FROM
(SELECT *, instr(lower(regexp_replace(r, '\\s+', ' ', 'g')), lower(regexp_replace(a, '\\s+', ' ', 'g'))) AS w0, CASE WHEN regexp_extract(lower(r), q) <> '' THEN instr(lower(r), regexp_extract(lower(r), q)) ELSE 0 END AS w,
 CASE WHEN regexp_extract(lower(r), q30) <> '' THEN instr(lower(r), regexp_extract(lower(r), q30)) ELSE 0 END AS f FROM
(SELECT *, regexp_replace(regexp_replace(lower(a), {SPECIAL}), '\\s+', '\\\\s+', 'g') AS q, regexp_replace(regexp_replace(lower(trim(substring(a, 1, 30))), {SPECIAL}), '\\s+', '\\\\s+', 'g') AS q30 FROM
(SELECT id, trim(anchor) AS a, start, substring(text, start + 1) AS r FROM {ANCHORS.sql})))""",
)
def anchor_locate(spark, sf_dir):
    return ANCHORS.df(spark, sf_dir).select("id", sp.find_anchor(F.col("text"), F.col("anchor"), F.col("start").cast("int")).alias("at"))


@query(
    "abstract_window",
    f"""WITH p AS {PAGE}, a AS (SELECT id, min(page) AS hit FROM p WHERE regexp_matches(text, '(?i)\\blicen[sc]ed\\b') GROUP BY id)
SELECT p.id, substring(string_agg(p.text, chr(10) || chr(10) ORDER BY page), 1, 18000) AS head FROM (SELECT id, text, min(page) AS page FROM (SELECT p.id, p.text, p.page FROM p LEFT JOIN a ON a.id = p.id WHERE (page < 2 OR abs(page - hit) <= 1) AND trim(p.text) <> '') x GROUP BY id, text) p GROUP BY p.id""",
)
def abstract_window(spark, sf_dir):
    head = sp.abstract_window(F.split("text", "\n"), r"(?i)\blicen[sc]ed\b")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), head.alias("head"))
