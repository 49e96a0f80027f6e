"""Catalogue reads and changes; the star schema and conversations stand for the operational tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.nested import variant_in, without_private
from ..operators import catalog as ct
from ..operators.messages import mapped_messages
from .base import Made, query, table


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


FILES = "SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(text) AS content_hash, doc_id FROM documents"


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.sha2("text", 256).alias("content_hash"), "doc_id")


CLASSIFY = f"""WITH f AS ({FILES}), s AS (SELECT content_hash, max(CASE WHEN doc_id % 9 <> 0 AND doc_id % 6 <> 0 THEN 1 ELSE 0 END) AS healthy FROM f WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT path, f.content_hash, CASE WHEN healthy = 1 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY f.content_hash ORDER BY path) > 1 THEN 'duplicate' WHEN healthy IS NOT NULL THEN 'repair' ELSE 'new' END AS state
FROM f LEFT JOIN s ON s.content_hash = f.content_hash"""


@query("sync_classify", CLASSIFY)
def sync_classify(spark, sf_dir):
    found = files(spark, sf_dir)
    stored = found.where("doc_id % 3 = 0").select(
        "content_hash", F.when(F.col("doc_id") % 9 == 0, "index_failed").otherwise("indexed").alias("status"), F.when(F.col("doc_id") % 6 == 0, 0).otherwise(4).alias("n_chunks")
    )
    return ct.classify_files(found.select("path", "content_hash"), stored)


@query(
    "sync_summary",
    f"SELECT job_id, count(*) AS total, CAST(count_if(state IN ('new', 'repair')) AS BIGINT) AS new, CAST(count_if(state = 'duplicate') AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed FROM (SELECT CAST(path AS BIGINT) % 5 AS job_id, state FROM ({CLASSIFY})) GROUP BY job_id",
)
def sync_summary(spark, sf_dir):
    items = sync_classify(spark, sf_dir).select((F.col("path").cast("long") % 5).alias("job_id"), F.when(F.col("state") == "duplicate", "duplicate").otherwise("saved").alias("status"))
    return ct.job_summary(items)


@query("library_counts", "SELECT n_nationkey AS library_id, n_name AS name, count(c_custkey) AS document_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def library_counts(spark, sf_dir):
    libraries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("library_id"), F.col("n_name").alias("name"))
    return ct.with_counts(libraries, "library_id", table(spark, sf_dir, "customer"), "c_nationkey", "document_count")


@query("document_summaries", "SELECT o_custkey AS library_id, o_orderkey AS id, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders) WHERE position <= 3")
def document_summaries(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("position", F.row_number().over(w).cast("long"))
    return rows.where("position <= 3").select(F.col("o_custkey").alias("library_id"), F.col("o_orderkey").alias("id"), "position")


@query(
    "document_details",
    "SELECT doc_id, source AS library, string_split(text, chr(10))[1] AS title, substring(text, 1, 500) AS abstract, sha256(text) AS file_hash, '' AS venue, n_chars FROM documents",
)
def document_details(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("library"), F.split("text", "\n")[0].alias("title"), F.substring("text", 1, 500).alias("abstract"),
        F.sha2("text", 256).alias("file_hash"), F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("venue"), "n_chars",
    )


@query(
    "sessions_ordered",
    """SELECT conv_id, n_turns, pinned, row_number() OVER (ORDER BY pinned DESC, n_turns DESC, conv_id DESC) AS position FROM (SELECT conv_id, max(turn) AS n_turns, conv_id % 7 = 0 AS pinned FROM conversations GROUP BY conv_id) ORDER BY position LIMIT 50""",
)
def sessions_ordered(spark, sf_dir):
    """The first page of sessions; positions are given after the limit, to the page alone."""
    from pyspark.sql import Window

    sessions = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n_turns")).withColumn("pinned", F.col("conv_id") % 7 == 0)
    order = [F.desc("pinned"), F.desc("n_turns"), F.desc("conv_id")]
    return sessions.orderBy(*order).limit(50).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("last_n_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def last_n_messages(spark, sf_dir):
    return ct.last_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 6)


@query("last_user_question", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_question(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


W = "list_distinct(list_filter(string_split(lower(replace({0}, chr(10), ' ')), ' '), lambda w: w <> ''))"


@query(
    "memory_recall",
    f"""WITH m AS (SELECT doc_id AS memory_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 END AS session_id, {W.format('text')} AS w, doc_id % 4 AS importance FROM documents),
q AS (SELECT item_id AS query_id, item_id % 5 AS session_id, {W.format('text')} AS a FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT query_id, memory_id, m.session_id AS ms, importance, len(list_intersect(w, a)) * 10 + importance AS score FROM m JOIN q ON m.session_id IS NULL OR m.session_id = q.session_id)
SELECT query_id, memory_id, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ms IS NOT NULL, importance DESC, memory_id) - 1 AS rank FROM s WHERE score > 0) WHERE rank < 5""",
)
def memory_recall(spark, sf_dir):
    d = F.col("doc_id")
    memories = table(spark, sf_dir, "documents").select(d.alias("memory_id"), F.when(d % 3 > 0, d % 5).alias("session_id"), F.col("text").alias("body"), (d % 4).alias("importance"))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).alias("session_id"), "text")
    return ct.recall_memories(memories, asked)


CHANGE = "SELECT p_partkey AS key, 'v2' AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 100000000, 'new' FROM part WHERE p_partkey % 50 = 0"


def change(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.lit("v2").alias("value")).unionByName(
        p.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 100000000).alias("key"), F.lit("new").alias("value"))
    )


@query("kv_upsert", f"WITH b AS (SELECT p_partkey AS key, p_name AS value FROM part), c AS ({CHANGE}) SELECT key, coalesce(c.value, b.value) AS value FROM b FULL JOIN c USING (key)")
def kv_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    return ct.upsert(base, change(spark, sf_dir), ["key"])


@query(
    "chunk_replace",
    """SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, arg_max(l_partkey, l_partkey * 10 + v) AS vector_id FROM (SELECT *, 0 AS v FROM lineitem UNION ALL SELECT * REPLACE (l_partkey + 5 AS l_partkey), 1 FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY 1, 2""",
)
def chunk_replace(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("vector_id"))
    new = old.where("document_id % 2 = 0").withColumn("vector_id", F.col("vector_id") + 5)
    return ct.upsert(ct.latest(old, ["document_id", "chunk_index"], "vector_id"), ct.latest(new, ["document_id", "chunk_index"], "vector_id"), ["document_id", "chunk_index"])


@query("conditional_bind", "SELECT o_orderkey AS session_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 7 WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS library_id FROM orders")
def conditional_bind(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("library_id"))
    return ct.set_where(sessions, F.col("library_id").isNull() & (F.col("session_id") % 2 == 0), library_id=F.lit(7).cast("long"))


@query("partial_update", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'renamed' ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_brand END AS folder FROM part")
def partial_update(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("folder"))
    key = F.col("id")
    new = base.where((key % 4 == 0) | (key % 6 == 0)).select("id", F.when(key % 4 == 0, "renamed").alias("name"), F.when(key % 6 == 0, "x").alias("folder"))
    return ct.patch(base, new, "id")


GONE = "SELECT c_custkey FROM customer WHERE c_nationkey = 3"


@query(
    "cascade_delete",
    f"""SELECT 'customer' AS tbl, count(*) AS n FROM customer WHERE c_custkey NOT IN ({GONE}) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN ({GONE})
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({GONE}))""",
)
def cascade_delete(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    tables["customer"], tables["orders"], tables["lineitem"] = tables["customer"].select("c_custkey", "c_nationkey"), tables["orders"].select("o_orderkey", "o_custkey"), tables["lineitem"].select("l_orderkey")
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    left = ct.delete_cascade(tables, links, "customer", tables["customer"].where("c_nationkey = 3"))
    counts = [df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("delete_guard", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_guard(spark, sf_dir):
    return ct.unreferenced(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@query("insert_ids", "SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def insert_ids(spark, sf_dir):
    base = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return ct.insert(base, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "id", ["name"])


@query("message_touch", "SELECT c_custkey AS session_id, greatest(coalesce(max(o_orderdate), TIMESTAMP '1990-01-01'), TIMESTAMP '1990-01-01') AS updated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def message_touch(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    sessions = table(spark, sf_dir, "customer").select("c_custkey").join(newest, "c_custkey", "left")
    return sessions.select(F.col("c_custkey").alias("session_id"), F.greatest(F.coalesce("last", start), start).alias("updated_at"))


@query("index_consistency", "SELECT source, count(*) AS n_documents, CAST(count_if(trim(text) <> '' AND n_chars > 0) AS BIGINT) AS n_indexable, count(*) <> count_if(trim(text) <> '' AND n_chars > 0) AS rebuild FROM documents GROUP BY source")
def index_consistency(spark, sf_dir):
    ok = F.count_if((F.trim("text") != "") & (F.col("n_chars") > 0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), ok.alias("n_indexable"), (F.count("*") != ok).alias("rebuild"))


OWN = Made("SELECT 's' || s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'own ' || s_name END AS value FROM @supplier WHERE s_suppkey % 3 <> 0")
BASE = Made("SELECT 's' || s_suppkey AS key, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS value FROM @supplier WHERE s_suppkey % 7 <> 0")


@query("config_layering", f"SELECT key, coalesce(nullif(trim(o.value), ''), b.value) AS value FROM (SELECT * FROM {BASE.sql}) b FULL JOIN (SELECT * FROM {OWN.sql}) o USING (key)")
def config_layering(spark, sf_dir):
    return ct.layered(OWN.df(spark, sf_dir), BASE.df(spark, sf_dir), "key")


@query("migration_backfill", "SELECT o_orderkey AS id, coalesce(c_nationkey, -1) AS library_id, 'recursive' AS chunk_mode FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def migration_backfill(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    filled = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey", "left")
    return ct.migrate(filled.select(F.col("o_orderkey").alias("id"), F.coalesce("c_nationkey", F.lit(-1)).alias("library_id")), {"chunk_mode": "recursive"})


FORM = Made(
    "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN '' WHEN 2 THEN c_mktsegment || ' ' || c_nationkey ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '/' || c_custkey END AS folder, CASE c_custkey % 3 WHEN 0 THEN '' || c_nationkey WHEN 1 THEN 'x' ELSE '2048' END AS tokens FROM @customer"
)


@query(
    "form_validation",
    f"""SELECT id, trim(name) = '' AS name_missing, count(*) OVER (PARTITION BY lower(trim(name))) > 1 AND trim(name) <> '' AS name_taken, trim(folder) = '' AS folder_missing, coalesce(TRY_CAST(tokens AS INTEGER), 0) <= 0 AS tokens_bad FROM {FORM.sql}""",
)
def form_validation(spark, sf_dir):
    from pyspark.sql import Window

    same = F.count("*").over(Window.partitionBy(tx.key(F.col("name"))))
    return FORM.df(spark, sf_dir).select(
        "id", (F.trim("name") == "").alias("name_missing"), ((same > 1) & (F.trim("name") != "")).alias("name_taken"),
        (F.trim("folder") == "").alias("folder_missing"), (F.coalesce(F.col("tokens").try_cast("int"), F.lit(0)) <= 0).alias("tokens_bad"),
    )


@query("selection_cascade", "SELECT o_orderkey AS session_id, coalesce(c.c_custkey, a.c_custkey) AS library_id FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o_custkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) a ON a.c_custkey = o_custkey + 1")
def selection_cascade(spark, sf_dir):
    """The session's own library if it still exists, else the active one (here the next) if it does, else none."""
    there = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own, active = there.withColumnRenamed("c_custkey", "own"), there.withColumnRenamed("c_custkey", "active")
    joined = s.join(own, F.col("o_custkey") == F.col("own"), "left").join(active, F.col("o_custkey") + 1 == F.col("active"), "left")
    return joined.select(F.col("o_orderkey").alias("session_id"), F.coalesce("own", "active").alias("library_id"))


NEW = Made("SELECT CASE c_custkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN upper(s_name) ELSE c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN 99 WHEN 1 THEN NULL ELSE c_nationkey END AS nation, c_custkey AS pos FROM @customer LEFT JOIN @supplier ON s_suppkey = c_custkey")
JUDGED = f"""n AS (SELECT * FROM {NEW.sql}), a AS (SELECT *, CASE WHEN coalesce(trim(name), '') = '' THEN 'name is required' WHEN nation IS NOT NULL AND nation NOT IN (SELECT n_nationkey FROM nation) THEN 'nation refers to nothing' END AS r FROM n),
j AS (SELECT *, coalesce(r, CASE WHEN lower(trim(name)) IN (SELECT lower(s_name) FROM supplier) OR row_number() OVER (PARTITION BY lower(trim(name)), r IS NULL ORDER BY pos) > 1 THEN 'name is taken' END) AS reason FROM a)"""


@query(
    "insert_checked",
    f"""WITH {JUDGED} SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS INTEGER) AS nation, 'there' AS state FROM supplier
UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY pos), name, nation, 'new' FROM j WHERE reason IS NULL UNION ALL SELECT NULL, name, nation, reason FROM j WHERE reason IS NOT NULL""",
)
def insert_checked(spark, sf_dir):
    """Customers as new suppliers: blank and taken names and unknown nations are rejected with the reason."""
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("nation"), F.lit(-1).cast("long").alias("pos"))
    rows = NEW.df(spark, sf_dir).withColumn("nation", F.col("nation").cast("int")).withColumn("pos", F.col("pos").cast("long"))
    after, rejected = ct.insert_checked(base, rows, "id", ["pos"], required=["name"], unique=["name"], foreign=[("nation", table(spark, sf_dir, "nation"), "n_nationkey")])
    state = F.when(F.col("pos") < 0, "there").otherwise("new")
    return after.select("id", "name", "nation", state.alias("state")).unionByName(rejected.select(F.lit(None).cast("long").alias("id"), "name", "nation", F.col("reason").alias("state")))


@query(
    "double_json",
    "SELECT event_id, CASE event_id % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 5 IN (2, 4) THEN NULL WHEN event_id % 5 = 3 THEN 'VOID' ELSE 'OBJECT' END AS kind FROM events",
)
def double_json(spark, sf_dir):
    """Properties as they are, encoded twice, broken, null, and as a text that is not to be read again."""
    e, quoted = F.col("event_id") % 5, lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    sent = F.when(e == 0, F.col("props")).when(e == 1, quoted(F.concat(F.lit(" "), "props"))).when(e == 2, F.concat(F.lit("{"), "props")).when(e == 3, "null").otherwise(F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('", "_x": 1}')))
    v = variant_in(sent)
    kind = F.when(e < 4, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), kind.alias("kind"))


@query("private_keys", "SELECT event_id, '{\"a\":[{\"b\":' || event_id || '},null],\"k\":' || json_extract_string(props, '$.k') || '}' AS body FROM events")
def private_keys(spark, sf_dir):
    """Members whose name begins with an underscore go, at any depth."""
    key, number = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    sent = F.concat(F.lit('{"_p": {"x": 1}, "k": '), key, F.lit(', "a": [{"_q": [1], "b": '), number, F.lit("}, null]}"))
    return table(spark, sf_dir, "events").select("event_id", without_private(sent).alias("body"))


MESSAGE = """CASE turn % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no json {' WHEN 2 THEN '{"documents": [{"id": ' || conv_id || '}, {"id": 2}], "memories": "x", "preparation": {"elapsed_seconds": ' || turn || '.5, "steps": [{"query": "q' || conv_id || '", "status": "odd"}, {"id": "s", "source": "openalex", "status": "error", "result_count": ' || turn || '}, 7]}}'
 WHEN 3 THEN '{"agent_trace": {"trace_id": ' || conv_id || ', "elapsed_ms": "' || (turn * 1000) || '", "spans": [{"name": "n' || turn || '", "elapsed_ms": null, "input": {"a": 1}, "output": [1]}, "bad", {}]}, "citations": [1, 2, 3]}'
 WHEN 4 THEN '[1]' ELSE '{"preparation": [], "agent_trace": {"status": "", "elapsed_ms": true}}' END"""
STORED = Made(f"SELECT conv_id, turn, {MESSAGE} AS retrieval_context_json FROM @conversations")


@query(
    "message_mapper",
    """SELECT conv_id, turn, CAST(CASE turn % 6 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS n_documents, CAST(CASE turn % 6 WHEN 3 THEN 3 ELSE 0 END AS INTEGER) AS n_citations, CASE turn % 6 WHEN 2 THEN turn + 0.5::DOUBLE WHEN 3 THEN turn::DOUBLE WHEN 5 THEN 0.001::DOUBLE END AS seconds,
CASE turn % 6 WHEN 2 THEN 'arxiv-q' || conv_id || ':success:arxiv:|s:error:openalex:' || turn WHEN 3 THEN '' WHEN 5 THEN '' END AS steps, CASE turn % 6 WHEN 3 THEN conv_id || ':success' WHEN 5 THEN ':success' END AS trace,
CASE turn % 6 WHEN 3 THEN 'n' || turn || ':n' || turn || ':0.0:{"a":1}:{}|:agent_step::{}:{}' WHEN 5 THEN '' END AS spans FROM conversations""",
)
def message_mapper(spark, sf_dir):
    """Contexts that are missing, broken, half filled and full, as typed columns with defaults."""
    m = mapped_messages(STORED.df(spark, sf_dir))
    text = lambda *c: F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in c))
    steps = F.array_join(F.transform("preparation.steps", lambda s: text(s["id"], s["status"], s["source"], s["result_count"])), "|")
    spans = F.array_join(F.transform("trace.spans", lambda s: text(s["span_id"], s["name"], s["elapsed_ms"], s["input"], s["output"])), "|")
    trace = F.when(F.col("trace").isNotNull(), text(F.col("trace.trace_id"), F.col("trace.status")))
    return m.select("conv_id", "turn", F.size("documents").alias("n_documents"), F.size("citations").alias("n_citations"), F.col("preparation.elapsed_seconds").alias("seconds"), steps.alias("steps"), trace.alias("trace"), spans.alias("spans"))


@query("memories_filtered", "SELECT event_id AS memory_id, row_number() OVER (ORDER BY event_id % 10 DESC, ts DESC, event_id) AS place FROM events WHERE event_type = 'view'")
def memories_filtered(spark, sf_dir):
    """Of two filters one is given."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id"), F.col("event_type").alias("scope"), F.col("user_id").alias("session_id"), (F.col("event_id") % 10).alias("importance"), F.col("ts").alias("created_at"))
    return ct.memories(rows, scope="view").select("memory_id", "place")


@query("libraries_by_time", "SELECT o_orderkey AS library_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def libraries_by_time(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("library_id"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"))
    return ct.numbered(newest, ["age", "library_id"], "place").select("library_id", "place")
