"""Citation formatting, numbering, rendering and matching."""

from pyspark.sql import functions as F

from ..functions.citation import FIELDS, with_citation
from ..operators import cite
from .base import Made, query, table

ENTRIES = [
    dict(id=1, authors="Ada Lovelace, Alan Turing and ada lovelace", title="On Machines.", year="1950", venue="Mind", volume="59", issue="236", pages="433--460", document_type="journal-article"),
    dict(id=2, authors="王小明；李雷", title="图神经网络", venue="中国计算机大会", publication_date="2021年3月5", publisher="科学出版社", publisher_place="北京", pages="1-9", document_type="[C]"),
    dict(id=3, authors="A. B.", title="A Thesis", document_type="thesis", degree_institution="Some University", degree_location="Paris", year="2019"),
    dict(id=4, authors="C. D", title="A Book", document_type="book", publisher="Press", publisher_place="New York", year="2001", pages="12"),
    dict(id=5, title="Preprint of things", url="https://example.org/p.", doi="https://doi.org/10.1000/abc.", source_type="arxiv", year="2023-7"),
    dict(id=6, title="With own address", url="https://doi.org/10.1000/xyz", doi="10.1000/xyz", document_type="J/OL", venue="Journal of X", access_date="2024-1-2"),
    dict(id=7, title="No data at all"),
    dict(id=8, authors="E F", title="Placeholder doi", doi="10.1234/xx.xxx", venue="Workshop on Y", year="around 2010"),
    dict(id=9, authors="G", title="", venue="Letters", volume="", issue="4", article_number="e17", year="n.d."),
    dict(id=10, title="Report", document_type="r", publisher="Agency", publication_date="2020.12"),
]


def entries(spark):
    schema = "id long, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame([tuple([e["id"], *(e.get(f, "") for f in FIELDS)]) for e in ENTRIES], schema)


def golden(spark):
    """References of the literal entries, which the tests hold against golden texts."""
    return with_citation(entries(spark), "2026-01-01", **{f: F.col(f) for f in FIELDS}).select("id", "citation")


KINDS = ["journal-article", "proceedings-article", "thesis", "book", "preprint", "standard"]
YEAR = "(1990 + p_size)"


@query(
    "gbt7714_format",
    f"""SELECT p_partkey AS id, CASE k WHEN 0 THEN p_brand || ', ' || p_type || '. ' || p_name || '[J]. ' || p_type || ', ' || {YEAR} || ', (' || p_size || '): e' || p_partkey || '.'
 WHEN 1 THEN p_brand || ', ' || p_type || '. ' || p_name || '[C]//' || p_type || '. ' || 'House ' || p_size || ', ' || {YEAR} || ': e' || p_partkey || '.'
 WHEN 2 THEN p_brand || ', ' || p_type || '. ' || p_name || '[D]. ' || 'House ' || p_size || ', ' || {YEAR} || '.'
 WHEN 3 THEN p_brand || ', ' || p_type || '. ' || p_name || '[M]. ' || 'House ' || p_size || ', ' || {YEAR} || ': e' || p_partkey || '.'
 WHEN 4 THEN p_brand || ', ' || p_type || '. ' || p_name || '[EB/OL]. ' || p_type || ', ' || {YEAR} || '. [2026-01-01]. DOI: 10.1000/' || p_partkey || '.'
 ELSE p_brand || ', ' || p_type || '. ' || p_name || '[S]. ' || 'House ' || p_size || ', ' || {YEAR} || ': e' || p_partkey || '. DOI: 10.1000/' || p_partkey || '.' END AS citation FROM (SELECT *, p_partkey % 6 AS k FROM part)""",
)
def gbt7714_format(spark, sf_dir):
    """Six types of works; authors come with repeats and different marks, the address is the DOI's own."""
    p = table(spark, sf_dir, "part")
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    doi = F.when(k >= 4, F.concat(F.lit("doi:10.1000/"), key, F.lit("."))).otherwise("")
    cited = with_citation(
        p, "2026-01-01", authors=F.concat("p_brand", F.lit(" and "), "p_type", F.lit("；"), F.lower("p_brand"), F.lit(",")), title=F.concat("p_name", F.lit(". ")), year=F.concat(F.lit("in "), (F.col("p_size") + 1990).cast("string")),
        document_type=F.get(F.array(*map(F.lit, KINDS)), k.cast("int")), venue=F.when(k.isin(2, 3, 5), "").otherwise(F.col("p_type")), publisher=F.when(k.isin(0, 4), "").otherwise(F.concat(F.lit("House "), F.col("p_size").cast("string"))),
        issue=F.col("p_size").cast("string"), article_number=F.concat(F.lit("e"), key), doi=doi, url=F.when(k >= 4, F.concat(F.lit("https://DOI.org/10.1000/"), key)).otherwise(""),
    )
    return cited.select(F.col("p_partkey").alias("id"), "citation")


@query(
    "gbt7714_catalog",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '. ' || p_name || '[J]. ' || p_type || ', ' || (1990 + p_size) || ', ' || p_size || '(' || (p_partkey % 12 + 1) || '): 1-' || p_size || '.'
ELSE p_brand || '. ' || p_name || '[M]. ' || p_type || ': Press, ' || (1990 + p_size) || '.' END AS citation FROM part""",
)
def gbt7714_catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, odd = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 1
    year = (F.col("p_size") + 1990).cast("string")
    cited = with_citation(
        p, "2026-01-01", authors=F.col("p_brand"), title=F.col("p_name"), year=year, document_type=F.when(odd, "M").otherwise("J"),
        venue=F.when(odd, "").otherwise(F.col("p_type")), publisher=F.when(odd, "Press").otherwise(""), publisher_place=F.when(odd, F.col("p_type")).otherwise(""),
        volume=F.when(odd, "").otherwise(size), issue=F.when(odd, "").otherwise((F.col("p_partkey") % 12 + 1).cast("string")), pages=F.when(odd, "").otherwise(F.concat(F.lit("1--"), size)),
    )
    return cited.select(F.col("p_partkey").alias("id"), "citation")


TAGGED = """SELECT conv_id * 1000 + turn AS answer_id, text || ' [@doc_' || (conv_id % 5) || ', @ext_a' || (turn % 3) || '] and [ doc_' || (turn % 4) || '、ext_2101.0' || (conv_id % 3) || 'v2 ] end [@doc_99]' ||
 CASE WHEN conv_id % 3 = 0 THEN chr(10) || ' References： ' || chr(10) || '[doc_4] own list' ELSE '' END AS body FROM conversations WHERE role = 'assistant'"""
SOURCES = ["doc_0", "doc_1", "doc_2", "doc_3", "doc_4", "ext_a1", "ext_a2", "ext_2101.00v2", "ext_2101.02v2"]
DOCS = f"SELECT unnest({SOURCES}) AS source_id"


def tagged(spark, sf_dir):
    """Every turn of the assistant with tags at its end, some with a list of references of their own."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = F.concat(
        "text", F.lit(" [@doc_"), (F.col("conv_id") % 5).cast("string"), F.lit(", @ext_a"), (F.col("turn") % 3).cast("string"),
        F.lit("] and [ doc_"), (F.col("turn") % 4).cast("string"), F.lit("、ext_2101.0"), (F.col("conv_id") % 3).cast("string"), F.lit("v2 ] end [@doc_99]"),
        F.when(F.col("conv_id") % 3 == 0, "\n References： \n[doc_4] own list").otherwise(""),
    )
    answers = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), body.alias("body"))
    docs = answers.select("answer_id", F.explode(F.array(*map(F.lit, SOURCES))).alias("source_id"))
    return answers, docs


TAG_SQL, SOURCE_SQL = r"\[\s*(?:@?(?:doc|ext)_[A-Za-z0-9_.-]+)(?:\s*[,;，；、]\s*@?(?:doc|ext)_[A-Za-z0-9_.-]+)*\s*\]", r"(?:doc|ext)_[A-Za-z0-9_.-]+"
NUMBERED = f"""WITH b AS ({TAGGED}), a AS (SELECT answer_id, regexp_replace(regexp_replace(body, '(?is)(^|\n)[ \t]*(参考文献|references)\\s*[:：]?[ \t]*(\n.*)?$', ''), '^\\s+|\\s+$', '', 'g') AS body FROM b WHERE body IS NOT NULL),
t AS (SELECT answer_id, unnest(regexp_extract_all(body, '{TAG_SQL}')) AS tag, generate_subscripts(regexp_extract_all(body, '{TAG_SQL}'), 1) AS k FROM a),
i AS (SELECT answer_id, k, tag, unnest(regexp_extract_all(tag, '{SOURCE_SQL}')) AS source_id, generate_subscripts(regexp_extract_all(tag, '{SOURCE_SQL}'), 1) AS j FROM t),
f AS (SELECT answer_id, source_id, min(k * 1000 + j) AS pos FROM i WHERE source_id IN ({DOCS}) GROUP BY 1, 2), n AS (SELECT answer_id, source_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS number FROM f)"""


@query("citation_numbering", f"{NUMBERED} SELECT * FROM n")
def citation_numbering(spark, sf_dir):
    return cite.numbered(*tagged(spark, sf_dir))


@query(
    "citation_render",
    f"""{NUMBERED}, r AS (SELECT answer_id, k, CASE WHEN count(number) = 0 THEN '' ELSE '[' || string_agg(number, ',' ORDER BY j) || ']' END AS new FROM i LEFT JOIN n USING (answer_id, source_id) GROUP BY 1, 2),
p AS (SELECT answer_id, unnest(regexp_split_to_array(body, '{TAG_SQL}')) AS piece, generate_subscripts(regexp_split_to_array(body, '{TAG_SQL}'), 1) AS k FROM a),
w AS (SELECT p.answer_id, regexp_replace(regexp_replace(regexp_replace(string_agg(piece || coalesce(new, ''), '' ORDER BY p.k), '^\\s+|\\s+$', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS plain FROM p LEFT JOIN r USING (answer_id, k) GROUP BY 1),
l AS (SELECT answer_id, string_agg('[' || number || '] ref ' || source_id, chr(10) ORDER BY number) AS refs FROM n GROUP BY 1)
SELECT answer_id, plain || coalesce(chr(10) || chr(10) || '参考文献' || chr(10) || refs, '') AS answer FROM w LEFT JOIN l USING (answer_id)""",
)
def citation_render(spark, sf_dir):
    answers, docs = tagged(spark, sf_dir)
    refs = docs.withColumn("citation", F.concat(F.lit("ref "), F.col("source_id")))
    return cite.render(answers, cite.numbered(answers, docs), refs)


REFS = Made(
    """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS answer_id, p_partkey AS ref, CASE p_partkey % 4 WHEN 0 THEN '[1] X. ' || p_name || ' ' || p_partkey || '[J]. DOI: 10.1000/M' || p_partkey || '.' WHEN 1 THEN upper(p_name) || ', no. ' || p_partkey WHEN 2 THEN 'https://doi.org/10.1000/m' || p_partkey || ')' ELSE 'Other ' || p_partkey END AS text FROM @part"""
)
HELD = Made(
    """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS answer_id, p_partkey + 1000000 AS document_id, p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.1000/M' || p_partkey ELSE '' END AS doi, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' no ' || p_partkey ELSE '' END AS citation, p_name AS title FROM @part"""
)
MATCH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\[[^\\]]+\\]', '', 'g'), 'https?://[^\\s]+', '', 'g'), '\\s+', '', 'g'), '[^\\pL\\pN]', '', 'g')"
DKEY = "regexp_replace(regexp_extract(lower(coalesce({0}, '')), '10\\.\\d{{4,9}}/[-._;()/:a-z0-9]+'), '[.,;:!?()]+$', '')"


@query(
    "reference_match_cascade",
    f"""WITH b AS (SELECT r.answer_id, ref, document_id, pos, {MATCH.format('r.text')} AS rt, {DKEY.format('r.text')} AS rd, {DKEY.format('h.doi')} AS dd, {MATCH.format('h.citation')} AS c, {MATCH.format('h.title')} AS tt
 FROM (SELECT * FROM {REFS.sql}) r JOIN (SELECT * FROM {HELD.sql}) h ON h.answer_id = r.answer_id),
k AS (SELECT *, CASE WHEN rd <> '' AND rd = dd THEN 1 WHEN c <> '' AND (contains(rt, c) OR contains(c, rt)) THEN 2 WHEN tt <> '' AND (contains(rt, tt) OR contains(tt, rt)) THEN 3 END AS tier FROM b)
SELECT answer_id, ref, arg_min(document_id, CAST(tier AS BIGINT) * 1000000000 + pos) AS document_id, CAST(min(tier) AS INTEGER) AS tier FROM k WHERE tier IS NOT NULL GROUP BY 1, 2""",
)
def reference_match_cascade(spark, sf_dir):
    return cite.match_references(REFS.df(spark, sf_dir), HELD.df(spark, sf_dir))


@query("title_fuzzy_match")
def title_fuzzy_match(spark, sf_dir):
    """First lines of even documents against those of odd ones; the ratio is that of matching blocks."""
    title = F.substring(F.split("text", "\n")[0], 1, 120)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"))
    return cite.fuzzy_titles(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"), 0.88)


RECORDS = "SELECT p_partkey AS id, '10.1000/' || (p_partkey % 40) AS doi, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title, CAST(p_size AS VARCHAR) AS year, p_brand AS venue FROM part"
REG = "SELECT 'https://doi.org/10.1000/' || s_suppkey AS doi, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN '2000' ELSE '' END AS year, 'V' || s_nationkey AS venue FROM supplier"


@query(
    "registry_enrichment",
    f"""SELECT r.id, r.doi, coalesce(nullif(g.year, ''), r.year) AS year, coalesce(nullif(g.venue, ''), r.venue) AS venue, coalesce(nullif(r.title, ''), g.title, '') AS title, g.doi IS NOT NULL AS matched,
 CASE WHEN g.doi IS NOT NULL THEN 'local+crossref' ELSE 'local' END AS sources FROM ({RECORDS}) r LEFT JOIN ({REG}) g ON g.doi = 'https://doi.org/' || r.doi""",
)
def registry_enrichment(spark, sf_dir):
    none = {c: F.lit("") for c in ("abstract", "publisher", "volume", "issue", "pages", "url")}
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    records = p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("10.1000/"), (F.col("p_partkey") % 40).cast("string")).alias("doi"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.col("p_size").cast("string").alias("year"), F.col("p_brand").alias("venue"), F.array(F.lit("local")).alias("metadata_sources"), *(v.alias(k) for k, v in none.items()),
    )
    registry = s.select(
        F.concat(F.lit("https://doi.org/10.1000/"), F.col("s_suppkey").cast("string")).alias("doi"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, "2000").otherwise("").alias("year"),
        F.concat(F.lit("V"), F.col("s_nationkey").cast("string")).alias("venue"), *(v.alias(k) for k, v in none.items()),
    )
    out = cite.enrich(records, registry)
    return out.select("id", "doi", "year", "venue", "title", "matched", F.array_join("metadata_sources", "+").alias("sources"))


DATES = Made(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '[[' || year(o_orderdate) || ',' || month(o_orderdate) || ',' || day(o_orderdate) || ']]' END AS online,
CASE WHEN o_orderkey % 4 < 2 THEN '[[' || year(o_orderdate) || ',' || month(o_orderdate) || ']]' END AS printed, CASE WHEN o_orderkey % 5 = 0 THEN '[[]]' WHEN o_orderkey % 5 < 4 THEN '[[' || year(o_orderdate) || ']]' END AS issued FROM @orders"""
)


@query(
    "date_parts",
    f"""SELECT id, coalesce({", ".join(f"CASE json_array_length({c}, '$[0]') WHEN 3 THEN printf('%04d-%02d-%02d', CAST(json_extract({c}, '$[0][0]') AS INTEGER), CAST(json_extract({c}, '$[0][1]') AS INTEGER), CAST(json_extract({c}, '$[0][2]') AS INTEGER)) WHEN 2 THEN printf('%04d-%02d', CAST(json_extract({c}, '$[0][0]') AS INTEGER), CAST(json_extract({c}, '$[0][1]') AS INTEGER)) WHEN 1 THEN printf('%04d', CAST(json_extract({c}, '$[0][0]') AS INTEGER)) END" for c in ("online", "printed", "issued"))}, '') AS published FROM {DATES.sql}""",
)
def date_parts(spark, sf_dir):
    """The first date that is there: online, in print, issued."""

    def day(c):
        p = F.get(F.from_json(c, "array<array<int>>"), F.lit(0))
        year, month, date = (F.get(p, F.lit(k)) for k in range(3))
        return F.when(F.size(p) >= 3, F.format_string("%04d-%02d-%02d", year, month, date)).when(F.size(p) == 2, F.format_string("%04d-%02d", year, month)).when(F.size(p) == 1, F.format_string("%04d", year))

    return DATES.df(spark, sf_dir).select("id", F.coalesce(*(day(F.col(c)) for c in ("online", "printed", "issued")), F.lit("")).alias("published"))


@query(
    "registry_types",
    "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'J' WHEN 1 THEN 'C' WHEN 2 THEN 'M' WHEN 3 THEN 'D' WHEN 4 THEN 'R' WHEN 5 THEN 'S' WHEN 6 THEN 'DB' WHEN 7 THEN 'EB/OL' ELSE 'Z' END AS code FROM part",
)
def registry_types(spark, sf_dir):
    kinds = ["Journal-Issue ", "proceedings", "edited-book", "dissertation", "report-series", " standard", "dataset", "posted-content", "peer-review"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cite.registry_code(kind).alias("code"))


ELIGIBLE = Made("SELECT doc_id, doc_id % 20 AS pos, CASE doc_id % 3 WHEN 0 THEN 'External' WHEN 1 THEN 'local' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'EXT_' || doc_id WHEN 1 THEN 'doc_' || doc_id END AS name, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang END AS title FROM @documents")


@query(
    "enrichment_eligible",
    f"SELECT doc_id, pos < 10 AND coalesce(trim(title), '') <> '' AND (coalesce(kind, '') = 'External' OR coalesce(name, '') LIKE 'EXT%') AS external, pos < 10 AND coalesce(trim(title), '') <> '' AND (kind IS NOT NULL OR name IS NOT NULL) AS every FROM {ELIGIBLE.sql}",
)
def enrichment_eligible(spark, sf_dir):
    parts = [F.col(c) for c in ("pos", "kind", "name")] + [F.lit(None).cast("string"), F.col("title")]
    return ELIGIBLE.df(spark, sf_dir).select("doc_id", cite.may_enrich(*parts).alias("external"), cite.may_enrich(*parts, include_local=True).alias("every"))


SAID = """SELECT conv_id * 1000 + turn AS answer_id, role, turn % 5 = 3 AS pending, conv_id, turn, CASE WHEN turn % 7 = 5 THEN ' ' WHEN conv_id % 3 = 1 THEN text || chr(10) || '参考文献：' || chr(10) || '[1] Paper ' || conv_id || ' of things' || chr(10) || 'not numbered' || chr(10) || ' [2]  Other' ELSE text END AS content FROM @conversations"""
ANSWERED = Made(SAID)


@query(
    "reference_entries",
    f"""WITH a AS (SELECT * FROM {ANSWERED.sql} WHERE role = 'assistant' AND trim(coalesce(content, '')) <> ''), own AS (SELECT * FROM a WHERE conv_id % 3 <> 0 AND conv_id % 3 = 1)
SELECT answer_id, CAST(k AS BIGINT) AS number, 'bound ' || k AS text, CAST(NULL AS BIGINT) AS document_id FROM a, (SELECT unnest([1, 2]) AS k) WHERE conv_id % 3 = 0
UNION ALL SELECT answer_id, 1, 'Paper ' || conv_id || ' of things', conv_id FROM own UNION ALL SELECT answer_id, 2, 'Other', NULL FROM own
UNION ALL SELECT answer_id, k, CASE k WHEN 1 THEN 'Paper ' || conv_id ELSE 'cited ' || conv_id END, CASE k WHEN 1 THEN conv_id ELSE conv_id + 1000000 END FROM a, (SELECT unnest([1, 2]) AS k) WHERE conv_id % 3 = 2 AND NOT pending""",
)
def reference_entries(spark, sf_dir):
    """Bound citations, else the answer's own list, else its documents; documents come in several chunks."""
    a = ANSWERED.df(spark, sf_dir)
    number = F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
    bound = a.where("conv_id % 3 = 0").select("answer_id", number.alias("number"), F.lit(None).cast("long").alias("document_id")).withColumn("text", F.concat(F.lit("bound "), F.col("number").cast("string")))
    conv, none = F.col("conv_id"), F.lit("")
    paper = F.struct(conv.alias("document_id"), F.lit(1).alias("pos"), none.alias("citation"), F.concat(F.lit("Paper "), conv.cast("string")).alias("title"))
    again = F.struct(conv.alias("document_id"), F.lit(3).alias("pos"), none.alias("citation"), F.lit("later chunk").alias("title"))
    other = F.struct((conv + 1000000).alias("document_id"), F.lit(2).alias("pos"), F.concat(F.lit("cited "), conv.cast("string")).alias("citation"), F.lit("zz").alias("title"))
    docs = a.select("answer_id", F.explode(F.array(paper, other, again)).alias("d")).select("answer_id", "d.*", none.alias("doi"))
    return cite.reference_entries(a, bound, docs)
