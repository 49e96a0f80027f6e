"""Whole plans on small inputs."""

from pyspark.sql import functions as F

from corpusflow.plans import hybrid as hy
from corpusflow.plans import ingest as ing


def test_hybrid_and_context(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.split("text", "\n")[0].alias("title"), F.substring("text", 1, 300).alias("abstract"),
        F.col("text").alias("chunk_text"), F.lit("").alias("venue"), F.lit("").alias("authors"), F.lit("").alias("citation"), F.array(F.lit("")).alias("authors_list"), F.lit("").alias("year"), F.lit("").alias("doi"),
    )
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.where("id < 3").select(F.col("id").alias("query_id"), F.lit("the reder of license").alias("text"), F.col("v").alias("q"))
    trace = hy.Trace()
    found = hy.hybrid(chunks, vectors, asked, trace=trace)
    rows = found.collect()
    seen = {r["stage"]: r["result_count"] for r in trace.rows(spark).orderBy("pos").collect()}
    assert list(seen) == ["vector_recall", "keyword_recall", "hybrid_rrf", "local_retrieval"]
    assert seen["vector_recall"] == 30 and seen["local_retrieval"] == len(rows) and 0 < seen["keyword_recall"] <= 30 and seen["hybrid_rrf"] == 30
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert set(counts) == {0, 1, 2} and all(0 < n <= 10 for n in counts.values())
    external = asked.select("query_id", F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1019).cast("long"))).alias("id")).withColumn("order", F.col("id"))
    context = hy.answer_context(found, None, external).collect()
    assert all(sum(r["query_id"] == q for r in context) == 10 for q in range(3))
    first = [r for r in context if r["query_id"] == 0 and r["origin"] == 0]
    assert len(first) == counts[0] and max(r["position"] for r in first) == counts[0]


def test_terms_of_several_tokens_are_phrases(spark):
    chunks = spark.createDataFrame([(1, "on deep-learning and GPT-4"), (2, "learning deep things, 4 GPT"), (3, "Deep Learning"), (4, "caf\u00e9 study"), (5, "another text")], "id long, chunk_text string")
    asked = spark.createDataFrame([(1, "deep-learning"), (2, "gpt-4"), (3, "study"), (4, "no_such-term")], "query_id long, text string")
    got = hy.keyword_recall(chunks, asked, {"chunk_text": 1.0}).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(1, 1), (1, 3), (2, 1), (3, 4)]


def test_ingest_is_incremental(spark, tmp_path):
    body = "A study of many things in graphs\nJournal of Graphs 2019\nAbstract: all of it. " + "word " * 200
    (tmp_path / "a.pdf").write_bytes(body.encode())
    (tmp_path / "copy.pdf").write_bytes(body.encode())
    (tmp_path / "bad.pdf").write_bytes(b"bad")

    def parser(content):
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().split("\f")

    none = spark.createDataFrame([], "content_hash string, status string, n_chunks int")
    docs, chunks, items, summary = ing.ingest(spark, str(tmp_path), none, parser, 200)
    assert [(r["title"], r["venue"], r["year"], r["document_type"], r["language"]) for r in docs.collect()] == [("A study of many things in graphs", "Journal of Graphs 2019", "2019", "J", "en")]
    assert chunks.where("length(chunk_text) > 200").count() == 0 and chunks.count() > 4
    assert [(r["total"], r["new"], r["skipped"], r["failed"]) for r in summary.collect()] == [(3, 1, 1, 1)]
    stored = docs.select(F.col("id").alias("content_hash"), F.lit("indexed").alias("status"), F.lit(5).alias("n_chunks"))
    again = ing.ingest(spark, str(tmp_path), stored, parser, 200)
    assert again[0].count() == 0 and [(r["new"], r["skipped"], r["failed"]) for r in again[3].collect()] == [(0, 2, 1)]


def loop_over_document(pages, size, batch_size=3):
    """The section pipeline for one document as a plain loop; sections by the rule of the query."""
    import re

    from corpusflow.config import Chunking
    from corpusflow.operators.split import split_text
    from corpusflow.plans import sections as se

    cut = lambda t: [c for c in split_text(t, size, min(Chunking().overlap, size - 1), Chunking().separators) if c.strip()]
    clean = [p.strip() for p in pages if p.strip()]
    source, begin, spans = "\n\n".join(clean), 0, []
    for p in clean:
        spans.append((begin, begin + len(p)))
        begin += len(p) + 2
    found, known = [], set()
    for k in range(0, len(clean), batch_size):
        low, high = spans[k][0], spans[min(k + batch_size, len(clean)) - 1][1]
        for n, p in enumerate([p for p in clean[k : k + batch_size] if len(p) >= 60]):
            start = lambda m, p=p: " ".join(re.split(r"\s+", p.strip())[:m])
            kind = "other" if len(p) % 5 == 0 else "introduction" if len(p) < 200 else "method"
            title, anchor = start(3), "Table 1" if len(p) % 7 == 0 else start(6)
            caption = re.compile(se.CAPTION).search
            heading = re.compile(se.HEADING).search
            if caption(title) or caption(anchor) or (re.search(se.NOISE, anchor) and not heading(anchor)) or (len(title) > 120 and not heading(title)):
                continue
            at = -1
            for text, shift in ((source[low:high], low), (source[low:], low)):
                for a in (anchor, anchor[:30].strip()):
                    m = re.search(r"\s+".join(map(re.escape, a.split())), text, re.I)
                    exact = text.find(anchor)
                    here = exact if exact >= 0 else m.start() if m else -1
                    if here >= 0 and at < 0:
                        at = here + shift
            if at < 0 or at > high or (at, kind, title) in known:
                continue
            known.add((at, kind, title))
            found.append((at, k, n, kind, title, len(p) % 4 != 0))
    found.sort()
    sections = []
    for n, (at, _, _, kind, title, indexable) in enumerate(found):
        text = source[at : found[n + 1][0] if n + 1 < len(found) else len(source)].strip()
        if not text:
            continue
        if sections and (sections[-1][0], sections[-1][1].lower(), sections[-1][2]) == (kind, title.lower(), indexable):
            sections[-1][3] += "\n\n" + text
        else:
            sections.append([kind, title, indexable, text])
    chunks = []
    for kind, title, indexable, text in sections:
        for c in cut(text) if indexable else []:
            if chunks and chunks[-1][:2] == [kind, title] and len(chunks[-1][2]) + 2 + len(c) <= size:
                chunks[-1][2] += "\n\n" + c
            else:
                chunks.append([kind, title, c])
    counts, out = {}, []
    for n, (kind, title, c) in enumerate(chunks):
        counts[kind, title] = counts.get((kind, title), -1) + 1
        out.append((kind, title, counts[kind, title], n, c))
    return out or [("recursive", "", n, n, c) for n, c in enumerate(cut(source))]


def test_section_pipeline_equals_a_loop(spark, sf):
    from corpusflow.queries import chunks as ch

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in ch.section_pipeline(spark, sf).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["section_type"], r["section_title"], r["section_chunk_index"], r["chunk_index"], r["chunk_text"]))
    assert sum(c[0][0] != "recursive" for c in got.values()) > 10
    for i, text in texts.items():
        assert got.get(i, []) == (loop_over_document(text.split("\n"), 400) if text else []), i


def test_sections_of_one_very_long_document(spark):
    from corpusflow.operators import split as sp

    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("pos"), (F.col("id") % 50_000 < 25_000).cast("string").alias("section"), F.lit("word").alias("text"))
    got = sp.merge_short(rows, 100, ["section"]).groupBy("section").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).collect()
    assert all(r["most"] <= 100 for r in got) and sum(r["n"] for r in got) == 4 * -(-25_000 // 17)


def test_truth_and_noise(spark):
    from corpusflow.plans import sections as se

    df = spark.createDataFrame([("Yes", "Fig. 2 shows", "x"), (" 0 ", "Method", "Downloaded on May 1"), (None, "t" * 130, "t"), ("maybe", "1. " + "t" * 130, "1. Vol. 3")], "v string, title string, anchor string")
    got = df.select(se.truth(F.col("v"), True).alias("v"), se.is_section(F.col("title"), F.col("anchor")).alias("ok")).collect()
    assert [(r["v"], r["ok"]) for r in got] == [(True, False), (False, False), (True, False), (True, True)]


def test_split_needs_a_provider_for_sections(spark):
    import pytest

    from corpusflow.plans.sections import split_documents

    docs = spark.createDataFrame([(1, "one two", "recursive"), (2, "", None)], "id long, text string, chunk_mode string")
    assert [r["chunk_text"] for r in split_documents(docs, None, None, 50).collect()] == ["one two"]
    with pytest.raises(ValueError):
        split_documents(docs.withColumn("chunk_mode", F.lit("semantic")), None, None, 50)
