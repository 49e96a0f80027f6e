"""Cutting texts into chunks: by separators, by pages and by sections."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Chunking


def cut_at(text: str, mark: str) -> list:
    """Pieces of a text, each but the first with the separator before it."""
    if not mark:
        return list(text)
    head, *rest = text.split(mark)
    return [p for p in (head, *(mark + r for r in rest)) if p]


def gather(parts: list, size: int, overlap: int) -> list:
    """Neighbouring parts joined up to the size; each chunk repeats the end of the one before."""
    out, held, total = [], [], 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    out.append("".join(held).strip())
    return [c for c in out if c]


def split_text(text: str, size: int, overlap: int, marks: tuple) -> list:
    """Chunks of at most ``size`` characters, at the coarsest separators that give them."""
    chunks: list = []
    todo = [(text, marks)]
    while todo:
        body, left = todo.pop()
        if body is None:
            chunks.extend(left)
            continue
        at = next((k for k, m in enumerate(left) if not m or m in body), len(left) - 1)
        finer, small, steps = left[at + 1 :], [], []
        for part in cut_at(body, left[at]):
            if len(part) < size or not finer:
                small.append(part)
                continue
            steps += [(None, gather(small, size, overlap)), (part, finer)]
            small = []
        steps.append((None, gather(small, size, overlap)))
        todo.extend(reversed(steps))
    return chunks


def recursive_split(docs: DataFrame, size: int, conf: Chunking = Chunking()) -> DataFrame:
    """(id, chunk_index, chunk_text) of ``docs`` (id, text): one row for each chunk that is not blank."""
    size = max(1, size)
    overlap, marks = max(0, min(conf.overlap, size - 1)), conf.separators

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [c for c in split_text(t, size, overlap, marks) if c.strip()] if t else [])

    return docs.select("id", F.posexplode(chunks("text")).alias("chunk_index", "chunk_text"))


def page_spans(pages: DataFrame) -> DataFrame:
    """``pages`` (id, page, text): where each page that is not blank begins and ends in the joined text."""
    w = Window.partitionBy("id").orderBy("page")
    held = pages.where(F.trim("text") != "")
    before = F.coalesce(F.sum(F.length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("start_char", before.cast("long")).withColumn("end_char", F.col("start_char") + F.length("text"))


def page_batches(pages: DataFrame, size: int = Chunking.pages_per_batch, spans: bool = False) -> DataFrame:
    """Batches of consecutive pages: first and last page, and the joined text; with ``spans`` also where it begins and ends."""
    number = F.row_number().over(Window.partitionBy("id").orderBy("page")) - 1
    listed = F.array_sort(F.collect_list(F.struct("page", "text")))
    ends = [F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")] if spans else []
    return pages.withColumn("batch", F.floor(number / size).cast("long")).groupBy("id", "batch").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), *ends, F.array_join(F.transform(listed, lambda p: p["text"]), "\n\n").alias("text")
    )


def section_texts(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, start_char, end_char, section_text) of ``sections`` (id, start_char) in ``docs`` (id, text): each runs to the next one's start.

    Sections that begin behind the text are left out.  The starts of a document meet its
    text as one list, and texts stream past these lists: none is sorted or repeated.
    """
    starts = sections.groupBy("id").agg(F.array_sort(F.collect_list("start_char")).alias("starts"))
    sized = docs.select("id", "text", F.length("text").cast("long").alias("size")).join(starts.hint("shuffle_hash"), "id")
    inside = sized.withColumn("starts", F.filter("starts", lambda s: s < F.col("size")))

    def cut(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("starts", n + 1), "size")
        text = F.trim(F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int")))
        return F.struct(start.alias("start_char"), end.alias("end_char"), text.alias("section_text"))

    return inside.select("id", F.explode_outer(F.transform("starts", cut)).alias("s")).where("s is not null").select("id", "s.*")


def merge_sections(sections: DataFrame, keys: list, first: tuple | list = ()) -> DataFrame:
    """Neighbours (by pos) with equal keys become one section; texts are joined in order, and of the columns ``first`` the first value stays."""
    w = Window.partitionBy("id").orderBy("pos")
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    opens = F.lag("pos").over(w).isNull()
    runs = sections.withColumn("starts", F.when(opens | changed, 1).otherwise(0)).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return runs.groupBy("id", "run", *keys).agg(F.min("pos").alias("pos"), F.count("*").alias("n_merged"), *(F.min_by(c, "pos").alias(c) for c in first), F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("text"))


def merge_short(chunks: DataFrame, size: int, keys: list) -> DataFrame:
    """Neighbours (by pos) with equal keys joined while the joined text fits ``size``: (id, chunk_index, keys, text).

    Rows of a document come to one task in order and are folded as they stream by, so
    the cost is linear in their number and one open chunk is held at a time.
    """
    ordered = chunks.select("id", *keys, "text", "pos").repartition("id").sortWithinPartitions("id", "pos").select("id", *keys, "text")
    schema = T.StructType([ordered.schema["id"], T.StructField("chunk_index", T.LongType()), *(ordered.schema[k] for k in keys), T.StructField("text", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def fold(batches):
        group, texts, length, index, begun = None, [], 0, 0, False
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own, text = row[:-1], row[-1] or ""
                if begun and own == group and length + 2 + len(text) <= size:
                    texts.append(text)
                    length += 2 + len(text)
                    continue
                if begun:
                    done.append((group[0], index, *group[1:], "\n\n".join(texts)))
                index = index + 1 if begun and own[0] == group[0] else 0
                group, texts, length, begun = own, [text], len(text), True
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * len(kinds), kinds)], schema.names)
        if begun:
            last = (group[0], index, *group[1:], "\n\n".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, kinds)], schema.names)

    return ordered.mapInArrow(fold, schema)


def renumber(chunks: DataFrame) -> DataFrame:
    """A number from 0 within each (document, type, title), in the order of the document."""
    w = Window.partitionBy("id", "section_type", "section_title").orderBy("pos")
    return chunks.withColumn("section_chunk_index", (F.row_number().over(w) - 1).cast("long"))


def find_anchor(text: Column, anchor: Column, start: Column) -> Column:
    """Position (from 0) of an anchor: as written, else with any white space, else by its first 30 characters; -1 if absent."""
    clean = F.trim(anchor)
    rest = F.substring(text, F.lit(1) + start, F.length(text))

    def loose(a: Column) -> Column:
        escaped = F.regexp_replace(a, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        return F.concat(F.lit("(?iu)"), F.regexp_replace(escaped, r"\s+", r"\\s+"))

    tries = (F.instr(rest, clean), F.regexp_instr(rest, loose(clean)), F.regexp_instr(rest, loose(F.trim(F.substring(clean, 1, 30)))))
    return F.when(clean == "", -1).otherwise(F.coalesce(*(F.nullif(t, F.lit(0)) for t in tries), -start) - 1 + start).cast("long")


def abstract_window(pages: Column, pattern: str = r"(?i)\babstract\b|摘\s*要", most: int = 18_000) -> Column:
    """The first two pages and those around the first page with an abstract, each once, cut to ``most`` characters."""
    hits = F.filter(F.transform(pages, lambda p, i: F.when(p.rlike(pattern), i)), lambda i: i.isNotNull())
    at = F.get(hits, F.lit(0))
    chosen = F.filter(pages, lambda p, i: (i < 2) | F.coalesce(F.abs(i - at) <= 1, F.lit(False)))
    return F.substring(F.array_join(F.array_distinct(F.filter(chosen, lambda p: F.trim(p) != "")), "\n\n"), 1, most)
