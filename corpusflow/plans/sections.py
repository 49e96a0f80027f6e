"""From pages to chunks along a document's sections.

Pages are joined to batches, a provider that is passed in names the sections that
begin in each batch, their anchors are located, and each section runs to the next
one.  Sections are cut into chunks and short neighbours are joined.  Whole texts are
cut into sections in one expression a document; all else works on rows of pages,
sections and chunks.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions.text import collapse
from ..operators import split as sp

#: What is no section (captions; page headers and footers), and what a heading begins with.
CAPTION = r"(?i)^\s*(?:fig\.?|figure|table|图|表)\s*[\dIVXLC一二三四五六七八九十]*"
NOISE = r"(?i)(?:authorized licensed use|downloaded on|restrictions apply|vol\.\s*\d+|transactions on|et al\.:)"
HEADING = r"(?i)^\s*(?:abstract|摘要|references|参考文献|appendix|附录|(?:[IVXLC]+|\d+)(?:[.\s、]|$))"
LONGEST_TITLE = 120
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TRUE, FALSE = ("true", "yes", "1", "y"), ("false", "no", "0", "n")
INK = r"(?U)[^\s\x1c-\x1f]"
KEYS = ["section_type", "section_title", "indexable"]
ROWS = "array<struct<pos: long, section_type: string, section_title: string, indexable: boolean, whole: boolean, text: string>>"


def stripped(c: Column) -> Column:
    """Without white space, as Unicode has it, at the ends."""
    return F.trim(c, F.lit(WHITE))


def truth(c: Column, default: bool) -> Column:
    """A truth value from a text in any of its usual forms; the default where it is none."""
    low = F.lower(stripped(c.cast("string")))
    return F.coalesce(F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False), F.lit(default))


def is_section(title: Column, anchor: Column) -> Column:
    """Not a caption, a page header or a title of more than ``LONGEST_TITLE`` characters that is no heading."""
    caption = title.rlike(CAPTION) | anchor.rlike(CAPTION)
    noise = anchor.rlike(NOISE) & ~anchor.rlike(HEADING)
    long = (F.length(title) > LONGEST_TITLE) & ~title.rlike(HEADING)
    return ~(caption | noise | long)


def batches(pages: DataFrame, size: int = Chunking.pages_per_batch) -> DataFrame:
    """(id, batch, first_page, last_page, start_char, end_char, text, following): ``text`` is that of the batch, ``following`` that of the next one."""
    clean = pages.select("id", "page", stripped(F.coalesce("text", F.lit(""))).alias("text"))
    joined = sp.page_batches(sp.page_spans(clean), size, spans=True)
    return joined.withColumn("following", F.coalesce(F.lead("text").over(Window.partitionBy("id").orderBy("batch")), F.lit("")))


def located(named: DataFrame) -> DataFrame:
    """(id, start_char, section_type, section_title, indexable) of ``batches`` with the column ``sections`` of a provider.

    ``sections`` is an array of structs of texts: section_type, title, start_anchor,
    indexable; null is none.  An anchor counts where it begins inside its batch, also if it
    runs over into the next one.  Of sections equal in place, type and title one stays.
    """
    read = F.transform("sections", lambda s: F.struct(*(collapse(s[c]).alias(c) for c in ("title", "start_anchor", "section_type")), truth(s["indexable"], True).alias("indexable")))

    def told(x: Column, n: Column) -> Column:
        title = F.when(x["title"] == "", F.concat(F.lit("section_"), n.cast("string"))).otherwise(x["title"])
        anchor = F.coalesce(F.nullif(x["start_anchor"], F.lit("")), x["title"])
        kind = F.coalesce(F.nullif(x["section_type"], F.lit("")), F.lit("other"))
        return F.struct(n.alias("n"), kind.alias("section_type"), title.alias("section_title"), anchor.alias("anchor"), x["indexable"].alias("indexable"))

    kept = F.filter(F.transform(read, told), lambda x: (x["anchor"] != "") & is_section(x["section_title"], x["anchor"]))
    zero, both, names = F.lit(0), F.concat("text", F.lit("\n\n"), "following"), ("n", "section_type", "section_title", "anchor", "indexable")
    # places are found inside the list, each once, before a section becomes a row
    own = F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in names), sp.find_anchor(F.col("text"), x["anchor"], zero).alias("at")))
    found = F.transform(own, lambda x: F.struct(*(x[c].alias(c) for c in names), F.when(x["at"] >= 0, x["at"]).otherwise(sp.find_anchor(both, x["anchor"], zero)).alias("at")))
    held = F.filter(found, lambda x: (x["at"] >= 0) & (x["at"] <= F.col("end_char") - F.col("start_char")))
    placed = named.select("id", "batch", "start_char", F.explode_outer(held).alias("s")).where("s is not null")
    placed = placed.select("id", "batch", (F.col("start_char") + F.col("s.at")).alias("start_char"), *(f"s.{c}" for c in names))
    first = Window.partitionBy("id", "start_char", "section_type", "section_title").orderBy("batch", "n")
    return placed.withColumn("k", F.row_number().over(first)).where("k = 1").select("id", "batch", "n", "start_char", "section_type", "section_title", "indexable")


def section_rows(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, pos, section_type, section_title, indexable, whole, text): each section up to the next one's start, blank ones left out.

    A document's text meets its sections once, as one list.  One without any section that gives
    chunks is one row more, its whole text, with ``whole``.
    """
    listed = F.array_sort(F.collect_list(F.struct("start_char", "batch", "n", *KEYS)))
    per = texts.join(sections.groupBy("id").agg(listed.alias("s")), "id", "left")
    end = lambda i: F.coalesce(F.get("s", i + 1)["start_char"], F.length("text").cast("long"))

    def row(x: Column, i: Column) -> Column:
        part = F.substring(F.col("text"), (x["start_char"] + 1).cast("int"), (end(i) - x["start_char"]).cast("int"))
        return F.struct(i.cast("long").alias("pos"), *(x[k].alias(k) for k in KEYS), F.lit(False).alias("whole"), stripped(part).alias("text"))

    plain = F.struct(F.lit(-1).cast("long").alias("pos"), F.lit("recursive").alias("section_type"), F.lit("").alias("section_title"), F.lit(True).alias("indexable"), F.lit(True).alias("whole"), F.col("text").alias("text"))
    cut = F.filter(F.transform("s", row), lambda x: x["text"] != "")
    gives = lambda x: x["indexable"] & x["text"].rlike(INK)
    # an array of one, so that the sections are cut once
    each = F.transform(F.array(F.coalesce(cut, F.array().cast(ROWS))), lambda c: F.when(F.exists(c, gives), c).otherwise(F.concat(c, F.array(plain))))
    return per.select("id", F.explode_outer(F.flatten(each)).alias("c")).select("id", "c.*")


def merged_sections(rows: DataFrame) -> DataFrame:
    """Neighbours of one type, title (whatever its case) and standing become one section under the first one's title."""
    low = rows.withColumn("low_title", F.lower("section_title"))
    one = sp.merge_sections(low, ["section_type", "low_title", "indexable", "whole"], first=["section_title"])
    return one.select("id", "pos", *KEYS, "whole", "text")


def recursive_rows(docs: DataFrame, size: int, conf: Chunking) -> DataFrame:
    plain = sp.recursive_split(docs.select("id", "text"), size, conf)
    return plain.select("id", F.lit("recursive").alias("section_type"), F.lit("").alias("section_title"), F.col("chunk_index").cast("long").alias("section_chunk_index"), F.lit(True).alias("indexable"), F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


def section_chunks(pages: DataFrame, detect: Callable[[DataFrame], DataFrame], size: int, conf: Chunking = Chunking()) -> DataFrame:
    """(id, section_type, section_title, section_chunk_index, indexable, chunk_index, chunk_text) of ``pages`` (id, page, text).

    ``detect`` adds the column ``sections`` to the batches.  Sections that are not to be
    indexed have no chunks; a document without any chunk is cut as a whole; one without text has none.
    """
    grouped = batches(pages, conf.pages_per_batch)
    listed = F.array_sort(F.collect_list(F.struct("batch", "text")))
    texts = grouped.groupBy("id").agg(F.array_join(F.transform(listed, lambda b: b["text"]), "\n\n").alias("text"))
    sections = merged_sections(section_rows(located(detect(grouped)), texts)).where("indexable")
    # a section's place in its document is its id for the splitter
    named = sections.withColumn("named", F.struct("id", "pos", "whole", *KEYS)).select(F.col("named").alias("id"), "text")
    place = F.struct(F.col("id.pos").alias("pos"), F.col("chunk_index").alias("n"))
    # chunks of a document that is cut as a whole stay as they are: no two have one ``piece``
    piece = F.when(F.col("id.whole"), F.col("chunk_index")).otherwise(-1)
    cut = sp.recursive_split(named, size, conf).select("id.id", *(f"id.{k}" for k in KEYS), piece.alias("piece"), place.alias("pos"), F.col("chunk_text").alias("text"))
    short = sp.merge_short(cut, size, [*KEYS, "piece"])
    return sp.renumber(short.withColumnRenamed("chunk_index", "pos")).select("id", "section_type", "section_title", "section_chunk_index", "indexable", F.col("pos").alias("chunk_index"), F.col("text").alias("chunk_text"))


def split_documents(docs: DataFrame, pages: DataFrame, detect: Callable[[DataFrame], DataFrame] | None, size: int, conf: Chunking = Chunking()) -> DataFrame:
    """Chunks of ``docs`` (id, text, chunk_mode), by sections where the mode is ``semantic``, else by separators."""
    semantic = F.coalesce(F.col("chunk_mode") == "semantic", F.lit(False))
    plain = recursive_rows(docs.where(~semantic), size, conf)
    if detect is None:
        if not docs.where(semantic).isEmpty():
            raise ValueError("semantic chunks need a provider of sections")
        return plain
    return plain.unionByName(section_chunks(pages.join(docs.where(semantic).select("id"), "id", "left_semi"), detect, size, conf))
