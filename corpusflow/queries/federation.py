"""Federated search on pages, events and literal records."""

from pyspark.sql import functions as F

from ..operators import federate as fd
from ..sources import papers
from ..sources.registry import Sources, TableSource
from ..sources.remote import RemoteSource
from .base import Made, query, table

TITLE = "trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"


def records(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), title.alias("title"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("10.1/"), F.col("page_id").cast("string"))).otherwise("").alias("doi"), "url")


@query(
    "external_anti_join",
    f"""WITH r AS (SELECT page_id AS id, {TITLE} AS title, CASE WHEN page_id % 4 = 0 THEN '10.1/' || page_id ELSE '' END AS doi FROM pages),
l AS (SELECT string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 8 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi FROM documents UNION ALL SELECT title, '' FROM r WHERE id % 10 = 1)
SELECT id, doi FROM r WHERE NOT (doi <> '' AND lower(doi) IN (SELECT lower(doi) FROM l)) AND NOT (title <> '' AND lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) IN (SELECT lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) FROM l))""",
)
def external_anti_join(spark, sf_dir):
    r = records(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.split("text", "\n")[0].alias("title"), F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).otherwise("").alias("doi"))
    local = docs.unionByName(r.where("id % 10 = 1").select("title", F.lit("").alias("doi")))
    return fd.without_local(r.select("id", "title", "doi"), local).select("id", "doi")


@query("external_greedy_dedupe")
def external_greedy_dedupe(spark, sf_dir):
    """Order-dependent, so tests hold it against a loop.  Addresses and DOIs of pages are made to collide, whole titles as they are."""
    r = records(spark, sf_dir)
    rows = r.select(
        (F.col("id") % 20).alias("query_id"), F.col("id").alias("pos"), "title", F.when(F.col("id") % 6 == 0, F.concat(F.lit("https://doi.org/10.5/"), (F.col("id") % 36).cast("string"))).otherwise("").alias("doi"),
        F.regexp_extract("url", "^[a-z]+://[^/?#]*/[^/?#]*", 0).alias("url"), F.lit("").alias("pdf_url"), F.lit("web").alias("source"), (F.col("id") % 200).cast("string").alias("external_id"),
    )
    return fd.keep_first_by_keys(fd.record_keys(rows), "query_id", "pos").select("query_id", "pos", "title", F.array_join("keys", " ").alias("keys"))


@query(
    "source_expand_cap",
    """SELECT plan_id, pos, source FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, source ORDER BY pos) AS n FROM (SELECT user_id AS plan_id, event_id AS pos, unnest(CASE WHEN event_type = 'click' THEN ['arxiv', 'openalex'] WHEN event_type = 'view' THEN ['arxiv'] ELSE ['openalex'] END) AS source FROM events)) WHERE n <= 3""",
)
def source_expand_cap(spark, sf_dir):
    sources = F.when(F.col("event_type") == "click", F.array(F.lit("arxiv"), F.lit("openalex"))).when(F.col("event_type") == "view", F.array(F.lit("arxiv"))).otherwise(F.array(F.lit("openalex")))
    plans = table(spark, sf_dir, "events").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("pos"), F.lit("").alias("keywords"), sources.alias("sources"))
    return fd.subtasks(plans).select("plan_id", "pos", "source")


PLANS = Made(
    """SELECT item_id % 25 AS plan_id, item_id AS pos, CASE item_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'ti:' || text WHEN 2 THEN 'Graph  neural NETS' WHEN 3 THEN 'graph neural nets' ELSE text END AS query,
CASE item_id % 4 WHEN 0 THEN 'arxiv, open-alex' WHEN 1 THEN 'arXiv' WHEN 2 THEN 'unknown' END AS sources, CASE item_id % 5 WHEN 0 THEN '2020' WHEN 1 THEN '20200230' WHEN 2 THEN '2021-05-06' WHEN 3 THEN '' END AS date_from, CASE item_id % 3 WHEN 0 THEN '9' WHEN 1 THEN 'x' ELSE '0' END AS most FROM @benchmark"""
)
WORDS = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
KEYWORDS = f"""(SELECT string_agg(w, '|' ORDER BY n) FROM (SELECT w, min(n) AS n FROM (SELECT {WORDS} AS w, n FROM (SELECT unnest(q) AS x, generate_subscripts(q, 1) AS n)) WHERE w <> '' GROUP BY w ORDER BY 2 LIMIT 4))"""


@query(
    "plan_normalize",
    f"""WITH p AS (SELECT *, regexp_split_to_array(translate(regexp_replace(regexp_replace(translate(query, '“”‘’„‟«»', '{2 * '"' + 4 * "'" + 4 * '"'}'), '(all|ti|abs|au):', '', 'g'), '(?i)\\b(AND|OR|NOT)\\b', '|', 'g'), '()"', '   '), '[|,;，；、]') AS q FROM {PLANS.sql}),
k AS (SELECT plan_id, pos, {KEYWORDS} AS keywords, CASE sources WHEN 'arxiv, open-alex' THEN 'arxiv|open_alex' WHEN 'arXiv' THEN 'arxiv' ELSE 'arxiv|openalex|open_alex' END AS sources,
 CASE date_from WHEN '2020' THEN '20200101' WHEN '2021-05-06' THEN '20210506' END AS date_from, CASE most WHEN '0' THEN 1 ELSE 5 END AS "limit" FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY plan_id, lower(replace(keywords, '|', ' ')) ORDER BY pos) AS n FROM k WHERE keywords IS NOT NULL)
SELECT plan_id, pos, keywords, sources, date_from, "limit" FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS m FROM o WHERE n = 1) WHERE m <= 3""",
)
def plan_normalize(spark, sf_dir):
    out = fd.normal_plans(PLANS.df(spark, sf_dir).withColumnRenamed("most", "limit"), ["arxiv", "openalex", "open_alex"])
    return out.select("plan_id", "pos", F.array_join("keywords", "|").alias("keywords"), F.array_join("sources", "|").alias("sources"), "date_from", "limit")


@query(
    "date_floor_filter",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-03-01'",
)
def date_floor_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))
    return fd.from_day(orders, F.col("published"), F.lit("19980301")).select("o_orderkey", F.to_date("published").alias("day"))


PAPERS = Made(
    """SELECT CASE WHEN page_id % 3 = 0 THEN '2101.' || page_id || 'v2' ELSE 'W' || page_id END AS external_id, CASE WHEN page_id % 3 = 0 THEN 'arxiv' ELSE 'openalex' END AS source, url, CASE WHEN page_id % 3 = 1 THEN url || '.pdf' END AS pdf_url FROM @pages"""
)


@query(
    "fulltext_resolution",
    f"""SELECT external_id, pdf AS pdf_url, coalesce(nullif(pdf, ''), land) AS download_url, land AS landing_url, source = 'arxiv' OR pdf <> '' AS is_open_access, CASE WHEN pdf <> '' THEN 'queue_ingest' ELSE 'answer_only' END AS decision FROM
(SELECT *, CASE WHEN source = 'arxiv' THEN 'https://arxiv.org/pdf/' || external_id ELSE coalesce(pdf_url, '') END AS pdf, CASE WHEN source = 'arxiv' THEN 'https://arxiv.org/abs/' || external_id ELSE coalesce(url, '') END AS land FROM {PAPERS.sql})""",
)
def fulltext_resolution(spark, sf_dir):
    return fd.ingest_decision(fd.fulltext(PAPERS.df(spark, sf_dir)))


@query(
    "request_urls",
    "SELECT item_id, 'https://export.arxiv.org/api/query?search_query=' || replace(replace(url_encode('all:\"' || string_split(text, ' ')[1] || '\" AND all:\"' || string_split(text, ' ')[2] || '\"'), '%20', '+'), '%2A', '*') || '&start=0&max_results=' || least(4 * (item_id % 7 + 1), 20) AS url FROM benchmark WHERE regexp_matches(string_split(text, ' ')[1] || string_split(text, ' ')[2], '^[A-Za-z]+$')",
)
def request_urls(spark, sf_dir):
    words = F.slice(F.split("text", " "), 1, 2)
    rows = table(spark, sf_dir, "benchmark").where(F.array_join(words, "").rlike("^[A-Za-z]+$"))
    return rows.select("item_id", fd.request_url(words, F.lit(0), (F.col("item_id") % 7 + 1).cast("int")).alias("url"))


@query(
    "external_rerank_guard",
    """WITH c AS (SELECT doc_id % 60 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 60 ORDER BY doc_id) - 1 AS recall_rank, round(CAST(n_chars % 97 AS DOUBLE), 4) AS score, count(*) OVER (PARTITION BY doc_id % 60) AS n FROM documents WHERE lang = 'fr' OR lang = 'de')
SELECT query_id, doc_id, recall_rank, score, position, n > 5 AS reranked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 THEN -CAST(recall_rank AS DOUBLE) ELSE score END DESC, recall_rank) AS position FROM c) WHERE position <= 5""",
)
def external_rerank_guard(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de")).select((F.col("doc_id") % 60).alias("query_id"), "doc_id", "n_chars")
    ranked = rows.withColumn("recall_rank", (F.row_number().over(w) - 1).cast("long"))
    return fd.rerank_or_pass(ranked, (F.col("n_chars") % 97).cast("double"), 5).drop("n_chars")


def feed_and_works(spark, sf_dir):
    """Parts as entries of Atom feeds, ten or so in each, and suppliers as JSON works, as catalogues send them."""
    key = F.col("p_partkey").cast("string")
    tag = lambda name, *c: F.concat(F.lit(f"<{name}>"), *c, F.lit(f"</{name}>"))
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/'), key, F.lit('" type="application/pdf"/>'))).otherwise(F.lit('<link href="http://arxiv.org/"/>'))
    entry = tag(
        "entry", tag("id", F.when(F.col("p_partkey") % 7 == 0, "bad").otherwise(F.concat(F.lit("http://arxiv.org/abs/"), key, F.lit("v2")))), tag("title", F.lit(" "), "p_name", F.lit("\n   again")), tag("summary", F.lit(" "), "p_type", F.lit(" ")),
        tag("published", (F.col("p_size") + 1990).cast("string"), F.lit("-01-02T00:00:00Z")), tag("author", tag("name", F.col("p_brand"))), tag("author", tag("name", F.lit("A  B"))), link,
    )
    sent = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 10").alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("x"))
    word = F.split("s_name", "#")[0]
    work = F.to_json(
        F.struct(
            F.concat(F.lit("https://openalex.org/W"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.5/"), F.col("s_suppkey").cast("string")).alias("doi"), F.col("s_name").alias("title"), (F.col("s_nationkey") + 1990).alias("publication_year"),
            F.array(F.struct(F.struct(word.alias("display_name")).alias("author"))).alias("authorships"), F.create_map(word, F.array(F.lit(1), F.lit(3)), F.lit("the"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"),
        )
    )
    works = table(spark, sf_dir, "supplier").select(F.from_json(work, papers.WORK).alias("w")).select("w.*")
    return papers.from_entries(papers.entries_of(sent, "x")), papers.from_works(works)


@query(
    "source_records",
    """SELECT 'arxiv' AS source, p_partkey || 'v2' AS external_id, p_name || ' again' AS title, p_brand || '; A B' AS authors, CAST(1990 + p_size AS VARCHAR) AS year, '' AS doi, p_type AS abstract, CASE WHEN p_partkey % 2 = 0 THEN 'http://arxiv.org/pdf/' || p_partkey ELSE '' END AS pdf_url FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'openalex', 'W' || s_suppkey, s_name, string_split(s_name, '#')[1], CAST(1990 + s_nationkey AS VARCHAR), '10.5/' || s_suppkey, 'the ' || string_split(s_name, '#')[1] || ' the ' || string_split(s_name, '#')[1], '' FROM supplier""",
)
def source_records(spark, sf_dir):
    """Feeds and works in their wire formats, through the registry of sources; an unknown source only adds an error row."""
    feed, works = feed_and_works(spark, sf_dir)
    sources = Sources(spark)
    sources.add("arxiv", lambda args: feed)
    sources.add("openalex", lambda args: works)
    found, _ = sources.search(["arxiv", "openalex", "nowhere"], {})
    return found.select("source", "external_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi", "abstract", "pdf_url")


class Flaky:
    """A provider that cannot answer for words of an even length."""

    def search(self, words, limit, date_from, sort, order):
        if len(words[0]) % 2 == 0:
            raise RuntimeError(f"no answer for {words[0]}")
        return [{"external_id": f"{words[0]}-{k}", "title": words[0]} for k in range(limit)]

    def detail(self, external_id):
        return {"external_id": external_id, "title": external_id.split("-")[0]}

    def fulltext(self, record):
        return {"pdf_url": f"https://f.org/{record['external_id']}.pdf", "is_open_access": True}


FIRST = "SELECT DISTINCT lower(string_split(replace(text, chr(10), ' '), ' ')[1]) AS w FROM benchmark"


def flaky_search(spark, sf_dir):
    """The first words of all benchmark items as requests to a remote source; they are the plan, so the driver holds them."""
    sources = Sources(spark)
    sources.add("flaky", RemoteSource(spark, "flaky", Flaky()))
    words = [r[0] for r in table(spark, sf_dir, "benchmark").select(F.lower(F.split("text", "[ \n]")[0])).distinct().collect()]
    return sources.search(["Flaky", "nowhere"], [{"words": [w], "limit": 2} for w in words])


@query("source_errors", f"SELECT 'flaky' AS source, 'no answer for ' || w AS message FROM ({FIRST}) WHERE len(w) % 2 = 0 UNION ALL SELECT 'nowhere', 'unknown source'")
def source_errors(spark, sf_dir):
    """Requests that fail are rows with their message, and the others answer."""
    return flaky_search(spark, sf_dir)[1]


@query("remote_search", f"SELECT 'flaky' AS source, w || '-' || k AS external_id, w AS title FROM ({FIRST}), range(2) r(k) WHERE len(w) % 2 = 1")
def remote_search(spark, sf_dir):
    return flaky_search(spark, sf_dir)[0].select("source", "external_id", "title")


def page_source(spark, sf_dir):
    """pages as a catalogue: their titles, addresses and years by id."""
    title = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    blank = F.lit("")
    rows = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("external_id"), title.alias("title"), F.array().cast("array<string>").alias("authors"), (F.col("page_id") % 30 + 1990).cast("string").alias("year"),
        blank.alias("venue"), blank.alias("doi"), "url", blank.alias("abstract"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".pdf"))).otherwise("").alias("pdf_url"),
    )
    return TableSource(rows)


@query("source_detail", f"SELECT 'P' || page_id AS external_id, {TITLE} AS title, url, CAST(1990 + page_id % 30 AS VARCHAR) AS year FROM pages WHERE page_id % 20 = 0")
def source_detail(spark, sf_dir):
    """Details by id, for all ids divisible by 20."""
    ids = table(spark, sf_dir, "pages").where("page_id % 20 = 0").select(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("external_id"))
    return page_source(spark, sf_dir).details(ids).select("external_id", "title", "url", "year")


@query(
    "source_fulltext",
    "SELECT 'P' || page_id AS external_id, pdf AS pdf_url, coalesce(nullif(pdf, ''), url, '') AS download_url, coalesce(url, '') AS landing_url, pdf <> '' AS is_open_access FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN coalesce(url || '.pdf', '') ELSE '' END AS pdf FROM pages)",
)
def source_fulltext(spark, sf_dir):
    sources = Sources(spark)
    sources.add("pages", page_source(spark, sf_dir))
    source = sources.of("pages")
    return source.fulltext(source.records).drop("message")
