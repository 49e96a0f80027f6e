"""Text functions on literal rows and on the text tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.hints import first_lines, is_person, title_of, venue_of, with_hints
from .base import Made, Texts, query, table

MESSY = Texts(
    [
        ("", True, ""), ("  A  study\u3000of   things. ", True, ""), ("doi: 10.1145/#.3409740.", False, ""), ("https://doi.org/10.1000/xyz.#, see also ", True, ""),
        ("10.1234/xxxx", False, ""), ("", False, ""), None, ("\u201cQuoted text\u201d and \u2018more\u2019 on deep-learning AND graphs; ", True, " or nets"),
        ("visit https://orcid.org/0000-# then https://example.org/a/#). Published 2019-7-3 ", True, ""), ("in 2021.12 and 1999 ", True, ""),
        ("pp. #--34.", False, ""), ("Title:  Mixed   CASE--Name # ", True, " DOI 10.1000/a(#)b."), ("ti:neural (networks) OR all:\"graph #\"; pruning, pruning", False, ""),
        ("C:/papers/one # two.pdf/", False, ""), ("rate limited: HTTP 429 Too Many Requests ", True, " http://x.org/#."), ("\u6df1\u5ea6\u5b66\u4e60\u7684 survey of 20# methods ", True, ""),
        ("2020-02-30", False, ""), ("20#", False, ""), ("20200229", False, ""),
    ]
)
WS = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
COL = f"trim(regexp_replace(coalesce(s, ''), '{WS}', ' ', 'g'))"
QUOTES = 2 * '"' + 4 * "'" + 4 * '"'
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"


def on(function, *names):
    def run(spark, sf_dir):
        return MESSY.df(spark, sf_dir).select("id", *(f(F.col("s")).alias(n) for n, f in zip(names, function)))

    return run


query("whitespace_normalize", f"SELECT id, {COL} AS collapsed, lower({COL}) AS key FROM {MESSY.sql}")(on([tx.collapse, tx.key], "collapsed", "key"))
query("match_normalize", f"SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(s, '')), 'https?://(dx\\.)?doi\\.org/', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM {MESSY.sql}")(on([tx.match_key], "k"))
query("doi_extract", f"SELECT id, rtrim(regexp_extract(coalesce(s, ''), '{DOI}'), '.,);]') AS doi FROM {MESSY.sql}")(on([tx.doi_in], "doi"))
query(
    "doi_clean",
    f"""SELECT id, CASE WHEN regexp_matches(d, '(?i)(^|[./_-])x{{2,}}($|[./_-])') THEN '' ELSE d END AS doi FROM
(SELECT id, rtrim(CASE WHEN contains(lower(p), 'doi.org/') THEN regexp_extract(p, '(?i)doi\\.org/(.*)$', 1) ELSE p END, '.,;') AS d FROM
(SELECT id, regexp_replace(rtrim({COL}, ' .。'), '(?i)^doi:\\s*', '') AS p FROM {MESSY.sql}))""",
)(on([tx.clean_doi], "doi"))
query(
    "url_extract",
    f"""SELECT id, coalesce(list_filter(list_transform(regexp_extract_all(coalesce(s, ''), 'https?://[^\\s<>"'']+'), lambda u: rtrim(u, '.,);]')), lambda u: NOT contains(lower(u), 'orcid.org'))[1], '') AS url FROM {MESSY.sql}""",
)(on([tx.url_in], "url"))
query("year_extract", f"SELECT id, regexp_extract(coalesce(s, ''), '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1) AS year FROM {MESSY.sql}")(on([tx.year_in], "year"))
DATE = r"\b(19\d{2}|20\d{2})(?:[-/.年](\d{1,2})(?:[-/.月](\d{1,2}))?)?"
query(
    "date_normalize",
    f"""SELECT id, CASE WHEN y = '' THEN '' WHEN m = '' THEN y WHEN d = '' THEN y || '-' || lpad(m, 2, '0') ELSE y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS day FROM
(SELECT id, regexp_extract(coalesce(s, ''), '{DATE}', 1) AS y, regexp_extract(coalesce(s, ''), '{DATE}', 2) AS m, regexp_extract(coalesce(s, ''), '{DATE}', 3) AS d FROM {MESSY.sql})""",
)(on([tx.partial_date], "day"))
query("pages_normalize", f"SELECT id, trim(regexp_replace(rtrim({COL}, ' .。'), '--|–|—', '-', 'g'), ' :.,;') AS pages FROM {MESSY.sql}")(on([tx.page_range], "pages"))
query("truncate_text", f"SELECT id, CASE WHEN len(c) > 24 THEN rtrim(substring(c, 1, 24)) || '...' ELSE c END AS title FROM (SELECT id, {COL} AS c FROM {MESSY.sql})")(on([lambda c: tx.clip(c, 24)], "title"))
query("reason_slug", f"SELECT id, regexp_replace(lower(trim(s)), '[\\s-]+', '_', 'g') AS slug FROM {MESSY.sql}")(on([tx.slug], "slug"))
query("path_basename", f"SELECT id, coalesce(nullif(regexp_extract(coalesce(s, ''), '([^/\\\\]+)[/\\\\]*$', 1), ''), '--') AS name FROM {MESSY.sql}")(on([lambda c: tx.base_name(c, "--")], "name"))
query(
    "query_keywords",
    f"""SELECT id, coalesce((SELECT string_agg(w, '|' ORDER BY n) FROM (SELECT w, min(n) AS n FROM (SELECT {COL.replace('coalesce(s', 'coalesce(x')} AS w, n FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS n)) WHERE w <> '' GROUP BY w ORDER BY 2 LIMIT 4)), '') AS keywords
FROM (SELECT id, regexp_split_to_array(translate(regexp_replace(regexp_replace(translate(coalesce(s, ''), '“”‘’„‟«»', '{QUOTES}'), '(all|ti|abs|au):', '', 'g'), '(?i)\\b(AND|OR|NOT)\\b', '|', 'g'), '()"', '   '), '[|,;，；、]') AS p FROM {MESSY.sql})""",
)(on([lambda c: F.array_join(tx.query_keywords(c), "|")], "keywords"))
query("fallback_keywords")(on([lambda c: F.array_join(tx.fallback_keywords(c), "|")], "keywords"))
query(
    "error_classify",
    f"SELECT id, CASE WHEN contains(lower(coalesce(s, '')), '429') OR contains(lower(coalesce(s, '')), 'too many requests') THEN 'rate_limited' ELSE 'other' END AS kind FROM {MESSY.sql}",
)(on([lambda c: F.when(F.lower(F.coalesce(c, F.lit(""))).rlike("429|too many requests"), "rate_limited").otherwise("other")], "kind"))
query(
    "date_floor",
    f"""SELECT id, day FROM (SELECT id, CASE WHEN len(f) = 8 AND try_strptime(f, '%Y%m%d') IS NOT NULL THEN f END AS day FROM
(SELECT id, CASE WHEN len(d) = 4 THEN d || '0101' ELSE d END AS f FROM (SELECT id, regexp_replace(coalesce(s, ''), '[^0-9]', '', 'g') AS d FROM {MESSY.sql})))""",
)(on([tx.day_number], "day"))

TYPED = Made(
    """SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'journal-article' WHEN 1 THEN '[C]' WHEN 2 THEN 'Thesis' WHEN 3 THEN '' WHEN 4 THEN 'unknown-kind' WHEN 5 THEN 'Preprint' WHEN 6 THEN ' Book ' WHEN 7 THEN 'eb/ol' WHEN 8 THEN 'degree thesis' END AS kind,
CASE p_size % 9 WHEN 0 THEN 'A dissertation on ' WHEN 1 THEN 'online ' ELSE '' END || p_name AS title, CASE p_partkey % 7 WHEN 0 THEN 'Proceedings of ' || p_brand WHEN 1 THEN 'arXiv preprint' WHEN 2 THEN p_type ELSE '' END AS venue,
CASE WHEN p_partkey % 5 < 2 THEN 'http://x.org/' || p_partkey ELSE '' END AS url FROM @part"""
)
CODES = "WHEN 'journal-article' THEN 'J' WHEN 'thesis' THEN 'D' WHEN 'degree thesis' THEN 'D' WHEN 'preprint' THEN 'EB/OL' WHEN 'book' THEN 'M'"


@query(
    "doc_type_infer",
    f"""SELECT id, CASE r {CODES} ELSE upper(r) END AS given,
CASE WHEN regexp_matches(s, '(学位论文|博士论文|硕士论文|dissertation|thesis)') THEN 'D' WHEN regexp_matches(s, '(conference|proceedings|symposium|workshop|会议|大会|论文集)') THEN 'C'
 WHEN regexp_matches(s, '(arxiv|preprint|online|web|网页|网络首发|urlid)') THEN CASE WHEN venue <> '' THEN 'J/OL' ELSE 'EB/OL' END WHEN venue <> '' THEN 'J' WHEN url <> '' THEN 'EB/OL' ELSE '' END AS inferred
FROM (SELECT *, trim(lower(trim(coalesce(kind, ''))), '[]') AS r, lower(title || ' ' || venue || ' ' || url) AS s FROM {TYPED.sql})""",
)
def doc_type_infer(spark, sf_dir):
    return TYPED.df(spark, sf_dir).select("id", tx.type_code(F.col("kind")).alias("given"), tx.infer_type(F.col("title"), F.col("venue"), F.col("url")).alias("inferred"))


@query(
    "lang_detect",
    "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) >= len(regexp_extract_all(text, '[A-Za-z]{3,}')) THEN 'zh' ELSE 'en' END AS language FROM documents",
)
def lang_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.language_of(F.col("text")).alias("language"))


MARKED_UP = Made("""SELECT page_id, html || '<p>&eacute;&amp;lt; &hellip;&unknown; caf&#233; &#x4E2D;&#65' || CAST(page_id % 10 AS STRING) || ';&#0;</p>' AS html FROM @pages""")
STRIP = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _e, _s in [("&#0;", "\ufffd"), ("&#233;", "é"), ("&#x4E2D;", "中"), *((f"&#65{k};", chr(650 + k)) for k in range(10)), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&hellip;", "…"), ("&amp;", "&")]:
    STRIP = f"replace({STRIP}, '{_e}', '{_s}')"


@query("html_strip", f"SELECT page_id, trim(regexp_replace({STRIP}, '{WS}', ' ', 'g')) AS content FROM {MARKED_UP.sql}")
def html_strip(spark, sf_dir):
    return MARKED_UP.df(spark, sf_dir).select("page_id", tx.strip_markup(F.col("html")).alias("content"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query(
    "url_normalize",
    "SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS key, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS host FROM pages",
)
def url_normalize(spark, sf_dir):
    u = F.lower(F.trim("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "/+$", "").alias("key"), F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]+)", 1).alias("host"))


PARTS = Made(
    """SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN '' WHEN event_id % 11 = 2 THEN 'a,b,c,d,e,f,g,h,i,j,k,l' || event_id ELSE event_type || '; ' || upper(event_type) || ', k ' || user_id || '，' || props || '、 ;x' END AS s FROM @events"""
)


def split_sql(pattern: str, cut: str, most: int, column: str) -> str:
    return f"""SELECT id, coalesce((SELECT string_agg(w, '|' ORDER BY n) FROM (SELECT arg_min(w, n) AS w, min(n) AS n FROM
 (SELECT trim({COL.replace('coalesce(s', 'coalesce(x')}, '{cut}') AS w, n FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS n)) WHERE w <> '' GROUP BY lower(w) ORDER BY 2 LIMIT {most})), '') AS {column}
FROM (SELECT id, regexp_split_to_array(coalesce(s, ''), '{pattern}') AS p FROM {PARTS.sql})"""


@query("keywords_split", split_sql("[,;，；、]", " ,;，；", 10, "keywords"))
def keywords_split(spark, sf_dir):
    return PARTS.df(spark, sf_dir).select("id", F.array_join(tx.split_keywords(F.col("s")), "|").alias("keywords"))


NAMES = Made(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '' ELSE c_custkey || '. ' || c_name || '*, Ada ' || c_mktsegment || ' and ' || lower(c_name) || 'AND  ada ' || lower(c_mktsegment) || '; 王小明' || c_nationkey END AS s FROM @customer"""
)
PERSON = f"regexp_replace({COL.replace('coalesce(s', 'coalesce(x')}, '^[^\\pL]+|[^\\pL]+$', '', 'g')"


@query(
    "authors_split",
    f"""SELECT id, coalesce((SELECT string_agg(w, '|' ORDER BY n) FROM (SELECT arg_min(w, n) AS w, min(n) AS n FROM (SELECT {PERSON} AS w, n FROM (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS n)) WHERE w <> '' GROUP BY lower(w) ORDER BY 2 LIMIT 12)), '') AS authors
FROM (SELECT id, regexp_split_to_array(regexp_replace(coalesce(s, ''), '\\s+(and|AND)\\s+', ',', 'g'), '[,;，；、]') AS p FROM {NAMES.sql})""",
)
def authors_split(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("id", F.array_join(tx.split_people(F.col("s")), "|").alias("authors"))


JSONS = Made(
    """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'Sure: {"a": ["x", " "], "n": "' || user_id || '"} done' WHEN 1 THEN event_type WHEN 2 THEN '["' || event_type || '", "", " ", "q' || event_id || '"]' WHEN 3 THEN '[bad ' || event_id WHEN 4 THEN props END AS s FROM @events"""
)


@query(
    "json_salvage",
    f"""SELECT id, nullif(regexp_extract(coalesce(s, ''), '(?s)\\{{.*\\}}', 0), '') AS body, json_extract_string(TRY_CAST(nullif(regexp_extract(coalesce(s, ''), '(?s)\\{{.*\\}}', 0), '') AS JSON), '$.n') AS n FROM {JSONS.sql}""",
)
def json_salvage(spark, sf_dir):
    body = tx.json_object_in(F.col("s"))
    return JSONS.df(spark, sf_dir).select("id", body.alias("body"), F.get_json_object(body, "$.n").alias("n"))


@query(
    "json_list_decode",
    f"SELECT id, coalesce(array_to_string(list_filter(TRY_CAST(CASE WHEN json_valid(s) AND json_type(s::JSON) = 'ARRAY' THEN s END AS JSON)::VARCHAR[], lambda x: trim(x) <> ''), '|'), '') AS items FROM {JSONS.sql}",
)
def json_list_decode(spark, sf_dir):
    listed = F.filter(F.from_json("s", "array<string>"), lambda x: F.trim(x) != "")
    return JSONS.df(spark, sf_dir).select("id", F.coalesce(F.array_join(listed, "|"), F.lit("")).alias("items"))


@query("json_dict_clean", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_dict_clean(spark, sf_dir):
    cleaned = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: (F.trim(k) != "") & (F.trim(v) != ""))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(cleaned, F.lit("k")), F.lit("")).alias("k"))


@query("inverted_abstract_restore", "SELECT item_id AS id, text AS abstract FROM benchmark")
def inverted_abstract_restore(spark, sf_dir):
    """From a map of words to positions, as catalogues send abstracts."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    grouped = words.groupBy("id", "word").agg(F.collect_list("pos").alias("at")).groupBy("id")
    maps = grouped.agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("words"))
    return maps.select("id", restore_abstract(F.col("words")).alias("abstract"))


def restore_abstract(words):
    placed = F.flatten(F.transform(F.map_entries(words), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


@query(
    "title_hint",
    """SELECT doc_id, coalesce(arg_max(line, len(line) * 1000 - n), '') AS title FROM (SELECT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(line) <> '') WHERE n <= 10 AND len(line) >= 8 AND NOT regexp_matches(lower(line), '^(abstract|keywords?)|@|doi|https?://|university|college|school|department|institute|lab|academy|correspondence|research center|email') GROUP BY doc_id""",
)
def title_hint(spark, sf_dir):
    """The longest of the first ten lines that may be a title; the first of equals.  Documents without one are left out."""
    lines = first_lines(F.col("text"), 10)
    # a row for each title, so that the condition reads the title that was found and does not look for it again
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.array(title_of(lines))).alias("title")).where("title <> ''")


ABSTRACTS = Made(
    """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Title here' || chr(10) || 'Abstract: ' || text || chr(10) || 'Keywords: a, b' WHEN 1 THEN text ELSE 'ABSTRACT' || chr(10) || text END AS s FROM @documents"""
)


@query(
    "abstract_hint",
    f"SELECT id, substring(trim(regexp_replace(regexp_extract(s, '(?is)\\babstract\\b\\s*:?\\s*(.*?)(?:\\bkeywords\\b|$)', 1), '{WS}', ' ', 'g')), 1, 3000) AS abstract FROM {ABSTRACTS.sql}",
)
def abstract_hint(spark, sf_dir):
    found = F.regexp_extract("s", r"(?is)\babstract\b\s*:?\s*(.*?)(?:\bkeywords\b|$)", 1)
    return ABSTRACTS.df(spark, sf_dir).select("id", F.substring(tx.collapse(found), 1, 3000).alias("abstract"))


@query("stream_rechunk", "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^，。；：,.!?;:\\n]{0,23}[，。；：,.!?;:\\n]|(?s:.{1,24})')) AS BIGINT) AS n, regexp_extract_all(text, '[^，。；：,.!?;:\\n]{0,23}[，。；：,.!?;:\\n]|(?s:.{1,24})')[1] AS first FROM conversations")
def stream_rechunk(spark, sf_dir):
    pieces = tx.pieces_at_marks(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(pieces).cast("long").alias("n"), F.get(pieces, F.lit(0)).alias("first"))


@query("session_titles", f"SELECT conv_id, CASE WHEN len(c) > 24 THEN rtrim(substring(c, 1, 24)) || '...' ELSE c END AS title FROM (SELECT conv_id, {COL.replace('coalesce(s', 'coalesce(text')} AS c FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id))")
def session_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select("conv_id", tx.clip(F.col("text"), 24).alias("title"))


@query("year_mode", "SELECT source, arg_max(y, n * 100000 - y) AS year FROM (SELECT source, 2000 + n_chars % 7 AS y, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def year_mode(spark, sf_dir):
    """The most frequent year of a source, the earliest of equals."""
    counts = table(spark, sf_dir, "documents").groupBy("source", (2000 + F.col("n_chars") % 7).alias("y")).count()
    return counts.groupBy("source").agg(F.max_by("y", F.struct("count", -F.col("y"))).alias("year"))


SHEETS = Texts(
    [
        ("A Study of Many Things #\nAda Lovelace*, Alan Turing 2 and Wang Xiaoming\nSome University\nAbstract: ", True, "\nKeywords: graphs; nets/Graphs,  trees #"),
        ("", True, ""),
        ("Journal of Graphs, Vol. 3\n\nOn Deep Networks for Text # and More\nB. O'Neil AND Ann-Marie Stone; b@x.org\nC. Day, School of Things\nE. Fox, G. Hill and\nabstract\n", True, "\n关键词：\n图神经网络、优化"),
        ("图神经网络研究综述第#\n王小明，李雷\n摘要: ", True, ""),
        ("short\n2019 Ada Lovelace, Bob Stone\nGrace Hopper 3 Barbara Liskov\n", True, "\nkeyword"),
        None,
        ("A Title About Letters of the ACM\nAdele Goldberg\n张三 李四光\nsee https://doi.org/10.1/#\n", True, ""),
    ]
)
AFFILIATED = "university|college|school|department|institute|laboratory|lab|academy|correspondence|research center|email|工程|学院|大学|研究所|实验室|通信作者|作者单位"
VENUE_WORDS = "journal|transactions|proceedings|conference|symposium|letters|ieee|acm|springer|elsevier|arxiv|学报|期刊|会议|大学学报|交通运输|铁道"
OPENS, KEYS, ENGLISH = "(?i)^(abstract|摘要)([^\\pL\\pN_]|$)", "(?i)^(?:keywords?|keyword|关键词)\\s*[:：]?", "[A-Z][A-Za-z''.-]+(?:\\s+[A-Z][A-Za-z''.-]+){{0,3}}".replace("{{", "{").replace("}}", "}")
PLAIN_LINE = f"trim(regexp_replace(regexp_replace(x, '[*†‡§]+|\\b\\d+\\b', ' ', 'g'), '{WS}', ' ', 'g'))"
HINTS = f"""WITH r AS (SELECT id, s, k, trim(regexp_replace(x, '{WS}', ' ', 'g')) AS x FROM (SELECT id, s, unnest(string_split(coalesce(s, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(s, ''), chr(10)), 1) AS k FROM {SHEETS.sql})),
l AS (SELECT id, s, x, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM r WHERE x <> ''),
t AS (SELECT id, arg_max(x, len(x) * 1000 - n) AS title FROM l WHERE n <= 10 AND len(x) >= 8 AND NOT regexp_matches(x, '{OPENS}') AND NOT regexp_matches(x, '{KEYS}') AND NOT regexp_matches(lower(x), 'doi|https?://|@|{AFFILIATED}') GROUP BY id),
v AS (SELECT id, substring(arg_min(x, n), 1, 240) AS venue FROM l WHERE n <= 40 AND regexp_matches(lower(x), '{VENUE_WORDS}') GROUP BY id),
e AS (SELECT id, coalesce(min(n) FILTER (WHERE n <= 40 AND regexp_matches(x, '{OPENS}')), least(count(*), 12) + 1) AS stop FROM l GROUP BY id),
w AS (SELECT l.id, n, {PLAIN_LINE} AS p FROM l JOIN e USING (id) WHERE n BETWEEN 2 AND 9 AND n < stop AND len(x) <= 120 AND NOT contains(x, '@') AND NOT regexp_matches(lower(x), '{AFFILIATED}') AND NOT regexp_matches(x, '\\b(19\\d{{2}}|20\\d{{2}})\\b')),
c AS (SELECT id, n, p, 1 AS how, unnest(regexp_split_to_array(p, '\\s*(?:,|，|、|;|；| and | AND )\\s*')) AS x, generate_subscripts(regexp_split_to_array(p, '\\s*(?:,|，|、|;|；| and | AND )\\s*'), 1) AS i FROM w WHERE regexp_matches(p, ',|，|、|;|；| and | AND ')
 UNION ALL SELECT id, n, p, 2, unnest(regexp_extract_all(p, '{ENGLISH}')), generate_subscripts(regexp_extract_all(p, '{ENGLISH}'), 1) FROM w UNION ALL SELECT id, n, p, 3, unnest(regexp_extract_all(p, '[一-鿿]{{2,4}}')), generate_subscripts(regexp_extract_all(p, '[一-鿿]{{2,4}}'), 1) FROM w),
q AS (SELECT id, n, p, how, name, min(i) AS i FROM (SELECT *, {PERSON} AS name FROM c) WHERE len(name) <= 80 AND NOT regexp_matches(lower(name), '{AFFILIATED}|http|@|[0-9]') AND regexp_full_match(name, '{ENGLISH}|[一-鿿]{{2,4}}') GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT id, n, how, count(*) AS m, string_agg(name, '|' ORDER BY i) AS names, any_value(p) AS p FROM q GROUP BY 1, 2, 3 HAVING how = 1 OR (how = 2 AND count(*) >= 2) OR (how = 3 AND count(*) <= 10 AND len(any_value(p)) <= 40)),
a AS (SELECT id, arg_min(names, n) AS authors FROM (SELECT id, n, arg_min(names, how) AS names, arg_min(m, how) AS m FROM z GROUP BY 1, 2) WHERE m <= 10 GROUP BY id),
k AS (SELECT id, n, trim(regexp_replace(x, '{KEYS}', ''), ' :：') AS own, lead(x) OVER (PARTITION BY id ORDER BY n) AS below, regexp_matches(x, '{KEYS}') AS marked FROM l),
f AS (SELECT id, arg_min(y, n) AS y FROM (SELECT id, n, CASE WHEN own <> '' THEN own WHEN below IS NOT NULL AND NOT regexp_matches(below, '{OPENS}') THEN trim(below, ' :：') ELSE '' END AS y FROM k WHERE marked) WHERE y <> '' GROUP BY id),
g AS (SELECT id, unnest(regexp_split_to_array(y, '\\s*(?:,|，|、|;|；|/|\\|)\\s*')) AS x, generate_subscripts(regexp_split_to_array(y, '\\s*(?:,|，|、|;|；|/|\\|)\\s*'), 1) AS i FROM f),
h AS (SELECT id, string_agg(x, '|' ORDER BY i) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS m FROM (SELECT id, arg_min(x, i) AS x, min(i) AS i FROM (SELECT id, i, trim({COL.replace('coalesce(s', 'coalesce(x')}, ' ,;，；') AS x FROM g) WHERE x <> '' GROUP BY id, lower(x))) WHERE m <= 10 GROUP BY id)
SELECT d.id, coalesce(title, '') AS title, coalesce(authors, '') AS authors, coalesce(keywords, '') AS keywords, coalesce(venue, '') AS venue FROM {SHEETS.sql} d LEFT JOIN t USING (id) LEFT JOIN a USING (id) LEFT JOIN h USING (id) LEFT JOIN v USING (id)"""


@query("metadata_hints", HINTS)
def metadata_hints(spark, sf_dir):
    """Documents under the heads of papers: titles, names, keywords and venues by rule."""
    told = with_hints(SHEETS.df(spark, sf_dir), "s")
    return told.select("id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"), "venue")


@query("person_names", f"SELECT c_custkey AS id, n AS name FROM (SELECT c_custkey, unnest([c_mktsegment, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || ' Smith', c_name, '王小' || chr(19968 + c_nationkey), 'Lab ' || c_mktsegment, lower(c_mktsegment), 'http Jones']) AS n FROM customer) WHERE regexp_full_match(n, '{ENGLISH}|[一-鿿]{{2,4}}') AND NOT regexp_matches(lower(n), '{AFFILIATED}|http|[0-9]')")
def person_names(spark, sf_dir):
    m = F.col("c_mktsegment")
    listed = F.array(m, F.concat(F.upper(F.substring(m, 1, 1)), F.lower(F.substring(m, 2, 100)), F.lit(" Smith")), F.col("c_name"), F.concat(F.lit("王小"), F.decode(F.unhex(F.hex(F.col("c_nationkey") + 19968)), "UTF-16BE")), F.concat(F.lit("Lab "), m), F.lower(m), F.lit("http Jones"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.filter(listed, is_person)).alias("name"))


@query("venue_hint", f"SELECT id, venue FROM ({HINTS}) WHERE venue <> ''")
def venue_hint(spark, sf_dir):
    sheets = SHEETS.df(spark, sf_dir)
    return sheets.select("id", F.explode_outer(F.array(venue_of(first_lines(F.coalesce("s", F.lit("")), 40)))).alias("venue")).where("venue <> ''")


LINED = Made("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(10) || ' ' || chr(10) || text || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || '  end  of it ' || chr(10) WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 2 THEN text END AS s, CASE doc_id % 3 WHEN 0 THEN 'a.b.' || doc_id || '.pdf' WHEN 1 THEN 'plain ' || doc_id ELSE '.hidden' || doc_id END AS f FROM @documents")


@query(
    "paragraph_lines",
    f"SELECT doc_id, trim(regexp_replace((SELECT coalesce(string_agg(trim(regexp_replace(x, '{WS}', ' ', 'g')), chr(10) ORDER BY n), '') FROM (SELECT unnest(string_split(replace(coalesce(s, ''), chr(13) || chr(10), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(coalesce(s, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) AS n)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS body, CASE WHEN contains(f, '.') THEN regexp_extract(f, '^(.*)\\.[^.]*$', 1) ELSE f END AS stem FROM {LINED.sql}",
)
def paragraph_lines(spark, sf_dir):
    """Lines in normal form with their paragraphs, and names without their suffix."""
    return LINED.df(spark, sf_dir).select("doc_id", tx.normal_lines(F.col("s")).alias("body"), tx.stem(F.col("f")).alias("stem"))


@query(
    "labelled_parts",
    "SELECT p_partkey AS id, coalesce(nullif(concat_ws('，', CASE WHEN p_partkey % 2 = 0 THEN '卷 ' || p_size END, CASE WHEN p_partkey % 3 = 0 THEN '期 ' || p_brand END, CASE WHEN p_partkey % 5 = 0 THEN '页 ' || p_type END), ''), '暂无') AS place, 'brand：' || p_brand || '；size：' || p_size AS extra FROM part",
)
def labelled_parts(spark, sf_dir):
    some = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.col(c).cast("string")).otherwise("")
    held = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.labelled({"卷": some(2, "p_size"), "期": some(3, "p_brand"), "页": some(5, "p_type"), "文章号": F.lit(None).cast("string")}, "暂无").alias("place"), tx.pairs(held).alias("extra"))
