"""Queries over writes to stored tables, each with its SQL. Parts are articles, orders link to them, events are changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import micro
from linkloom.operators import catalog, history, store
from linkloom.sources.tables import articles, changes, edges, read


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.col("p_size").cast("long").alias("doc_len"), F.lit(None).cast("long").alias("inbound"))


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth part and as many new ones are written; who links to them stays as stored."""
    old = _parts(spark, d).withColumn("inbound", F.col("id") % 7)
    new = old.where("id % 10 = 0").select("id", F.lit("new").alias("type"), (F.col("doc_len") + 1).alias("doc_len"))
    new = new.unionByName(new.withColumn("id", F.col("id") + 1_000_000_000))
    return store.upsert(old, new, "id", ["inbound"])


def _deleted(spark: SparkSession, d: str):
    e = edges(spark, d).select("source", "target", "place")
    postings = e.select(F.col("target").alias("doc_id"), F.col("place").alias("term_id"))
    return store.delete_documents(_parts(spark, d).select("id"), e, postings, _parts(spark, d).where("id % 9 = 0").select("id"))


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[1]


def deleted_affects(spark: SparkSession, d: str) -> DataFrame:
    return _deleted(spark, d)[3]


def put_postings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the first orders of each customer segment as postings written anew; a term without an id takes a place all the same."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("term"), F.col("l_quantity").cast("long").alias("weight"), F.col("l_linenumber").alias("first"))
    terms = read(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("term"), (F.col("s_suppkey") * 10).alias("term_id"))
    old = lines.join(terms, "term").select("doc_id", "term_id", "weight", F.lit(0).alias("pos"))
    return store.put_postings(old, lines.where("doc_id % 5 = 0"), terms)


def save_columns(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).drop("inbound")
    return store.save_columns(p, p.where("id % 3 = 0").select("id", F.lit(None).cast("long").alias("doc_len")).unionByName(p.limit(0).select("id", "doc_len")), "id")


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the fingerprint of their content and of what was indexed: others for every fifth, none for every seventh."""
    p = read(spark, d, "part")
    fresh = F.md5(F.concat_ws("\x1f", "p_name", "p_brand"))
    old = F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 0, F.md5("p_name")).otherwise(fresh)
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0).alias("doc_len"), fresh.alias("hash"), old.alias("lex_hash"), F.lit(0).cast("long").alias("lex_at"))


def mark_indexed(spark: SparkSession, d: str) -> DataFrame:
    docs = _hashed(spark, d)
    return store.mark_indexed(docs, store.behind(docs).where("id % 2 = 0").select("id", "hash"), F.lit(99).cast("long"))


def index_behind(spark: SparkSession, d: str) -> DataFrame:
    return store.behind(_hashed(spark, d)).select("id")


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """Customers as CSV records, cells guarded and quoted."""
    c = read(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("=")).otherwise(F.lit("")), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(', "x"')).otherwise(F.lit(""))).alias("title"), "c_mktsegment")
    return store.csv_rows(c, ["c_custkey", "title", "c_mktsegment"])


def links_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stored links of orders whose content didn't change, links read anew of the others."""
    e = edges(spark, d).select("source", "place", "target", "broken")
    docs = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.md5("o_orderstatus").alias("hash"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("old")).otherwise(F.md5("o_orderstatus")).alias("graph_hash"))
    return store.links_of(e, e.withColumn("target", F.col("target") + 1), docs)


def put_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("lang"), F.col("embedding").alias("vector"))
    after = store.put_vectors(v.where("id % 3 <> 0"), v.where("id % 2 = 0").withColumn("lang", F.lit("moved")))
    return after.select("id", "lang", F.size("vector").cast("long").alias("width"), micro(F.col("vector")[0]).alias("head"))


def dismissals_after(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("source", "target", "place", "broken")
    return store.dismiss(e.where("broken"), e.where("place = 1"), e.where("place = 2").select("source", "target").distinct(), _parts(spark, d).where("id % 20 = 0").select("id"))


def penalized_published(spark: SparkSession, d: str) -> DataFrame:
    """Targets that over ten published orders of the first priorities dismissed."""
    published = read(spark, d, "orders").where("o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')").select(F.col("o_orderkey").alias("source"))
    pairs = edges(spark, d).select("source", "target").distinct().join(published, "source", "left_semi")
    return pairs.groupBy("target").agg(F.count("*").alias("n")).where("n > 10")


def dependents_or_broken(spark: SparkSession, d: str) -> DataFrame:
    """Orders that link to a part, or that hold a broken link to an address like its own, without those themselves."""
    e, ids = edges(spark, d), _parts(spark, d).where("id % 50 = 0").select("id")
    linking = e.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    slugs = ids.select(F.concat(F.lit("-"), F.col("id").cast("string"), F.lit("/")).alias("slug"), F.col("id").alias("target"))
    urls = e.where("broken").select("source", F.concat(F.lit("/p-"), F.col("url").cast("string"), F.lit("/")).alias("url"))
    like = urls.withColumn("slug", F.regexp_extract("url", r"(-\d+/)", 1)).join(slugs, "slug", "left_semi").select(F.col("source").alias("id"))
    return linking.unionByName(like).distinct().join(ids, "id", "left_anti")


def changes_after(spark: SparkSession, d: str) -> DataFrame:
    log = changes(spark, d).select("id", "article", F.when(F.col("undone"), F.lit(5).cast("long")).alias("undone_at"))
    new = log.where("id % 100 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return store.changes_after(log, new, log.where("id % 3 = 0").select("id"), log.where("id % 11 = 0").select("id"), F.lit(77).cast("long"))


def history_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Articles with changes that still hold: how many, how many of them hold, and when last something was done or undone; the last first."""
    log = changes(spark, d).withColumn("undone_at", F.when(F.col("undone"), F.unix_micros(F.col("at").cast("timestamp")) + 60_000_000))
    at = F.greatest(F.unix_micros(F.col("at").cast("timestamp")), F.coalesce("undone_at", F.lit(0)))
    own = log.groupBy("article").agg(F.count("*").alias("total"), F.count_if(F.col("undone_at").isNull()).alias("active"), F.max(at).alias("last_at"), F.max("id").alias("last_id"))
    return own.where("active > 0").select("article", "total", "active", "last_at", "last_id")


def history_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Live changes of some kinds in a range of articles whose customer's name holds a 7; without that search changes of unknown articles stay too."""
    titles = read(spark, d, "customer").select(F.col("c_custkey").alias("article"), F.col("c_name").alias("title"))
    log = history.live(changes(spark, d))
    named = history.search(log, titles, "7", ["click", "view", "purchase", "signup"], 1, 100000).withColumn("part", F.lit("named"))
    every = history.search(log, titles, actions=["click"], high=50).withColumn("part", F.lit("all"))
    return named.unionByName(every).select("part", "article", "action", "id", "title")


def tokens_today(spark: SparkSession, d: str) -> DataFrame:
    """Use since the midnight before the log's last entry."""
    days = changes(spark, d).groupBy(F.to_date("at").alias("day")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("tokens"))
    return days.agg(F.max_by("tokens", "day").alias("tokens"))


def nightly_tasks(spark: SparkSession, d: str) -> DataFrame:
    live = read(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("id"))
    back = edges(spark, d).where("place = 1").select(F.col("target").alias("source"), "broken")
    return store.reconcile(_hashed(spark, d), live, back)


def history_listing(spark: SparkSession, d: str) -> DataFrame:
    """The second 25 articles of the log by their last change, as someone who may edit English articles sees them."""
    own = articles(spark, d).select(F.col("doc_id").alias("article"), "title", "lang")
    found = history.listing(changes(spark, d), own.select("article", "title"), own.where("lang = 'en'"), page=2, size=25)
    return found.withColumn("last_at", F.unix_seconds(F.col("last_at").cast("timestamp")))


def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events as AI calls: purchases are done, errors have a text, tokens are k less 50, the model is named by the whole of props."""
    log = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    calls = log.select(F.col("event_id").alias("id"), F.repeat("event_type", 8).alias("type"), F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("status"), (k - 50).alias("tokens"), ((F.col("value") - 20) / 8).alias("cost"),
        F.col("event_type").alias("provider"), F.repeat("props", 12).alias("model"), F.when(F.col("event_type") == "error", F.col("props")).otherwise("").alias("error"))
    return history.ledger(calls).withColumn("cost", (F.col("cost") * 1_000_000).cast("long"))


def coalesced_notices(spark: SparkSession, d: str) -> DataFrame:
    log = changes(spark, d).select(F.date_trunc("hour", F.col("at").cast("timestamp")).alias("hour"), "article", "id")
    return store.coalesced(log.select(F.unix_seconds("hour").alias("request"), "article", "id"))


def excluded_report(spark: SparkSession, d: str) -> DataFrame:
    """Articles outside the index with the reason: their own mark, else their category."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("category"), (F.col("c_custkey") % 13 == 0).alias("marked"))
    out = read(spark, d, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("category"), F.lit(True).alias("by"))
    found = c.join(out, "category", "left").where("marked OR by")
    return found.select("id", "title", "type", F.when(F.col("marked"), "entry").otherwise("category").alias("reason"))


def requirement_matches(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' sets of brands: those of a nation that share a brand, and a size, with the one with the smallest key."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "part"), F.expr("l_partkey = p_partkey")).join(read(spark, d, "supplier"), F.expr("l_suppkey = s_suppkey"))
    own = lines.groupBy(F.col("l_suppkey").alias("id"), F.col("s_nationkey").alias("type")).agg(F.collect_set("p_brand").alias("brands"), F.collect_set(F.col("p_size") % 5).alias("sizes"))  # a handful of values
    first = own.where("id = 1")
    return catalog.meets(own, catalog.requirement(first, ["brands", "sizes"]), ["brands", "sizes"]).select("id")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Report rows as they are shown: yes and no, and times as RFC 3339."""
    o = read(spark, d, "orders")
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("done"), at.alias("at"))


def pillars(spark: SparkSession, d: str) -> DataFrame:
    """Articles that bear one of three marks, the last only where its owner is active."""
    marks = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") == 1).alias("own"), (F.col("p_brand") == "Brand#11").alias("first"), (F.col("p_type").startswith("PROMO")).alias("second"))
    active = {"first": True, "second": False}
    held = F.col("own")
    for name, on in active.items():
        held = held | F.col(name) if on else held
    return marks.where(held).select("id").distinct()


def shared_values(spark: SparkSession, d: str) -> DataFrame:
    """How many brands the parts that a supplier and an order share have in common, for suppliers of one nation."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    s = lines.join(read(spark, d, "supplier").where("s_nationkey = 5").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    own = s.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("a"))  # brands are a handful
    wanted = F.array(F.lit("Brand#11"), F.lit("Brand#22"), F.lit("Brand#33"))
    return own.select(F.col("l_suppkey").alias("id"), F.arrays_overlap("a", wanted).alias("meets"), F.size(F.array_intersect("a", wanted)).cast("long").alias("affinity"))


_H = "h AS (SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS doc_len, md5(p_name || chr(31) || p_brand) AS hash, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN md5(p_name) ELSE md5(p_name || chr(31) || p_brand) END AS lex_hash FROM part)"
_B = "doc_len > 0 AND lex_hash IS DISTINCT FROM hash"
_LIVE = "lv AS (SELECT user_id AS article, event_type AS action, max(event_id) AS id FROM events GROUP BY ALL HAVING max(event_id) % 7 <> 0)"
QUERIES = {f.__name__: f for f in (upsert_documents, delete_documents, deleted_affects, put_postings, save_columns, mark_indexed, index_behind, csv_export, links_of_documents, put_vectors, dismissals_after, penalized_published, dependents_or_broken, changes_after, history_by_status, history_filtered, tokens_today, nightly_tasks, history_listing, usage_ledger, coalesced_notices, excluded_report, requirement_matches, report_rows, pillars, shared_values)}
SQL = {
    "upsert_documents": """WITH o AS (SELECT p_partkey AS id, p_brand AS type, CAST(p_size AS BIGINT) AS doc_len, CAST(p_partkey % 7 AS BIGINT) AS inbound FROM part), n AS (SELECT id, doc_len + 1 AS doc_len FROM o WHERE id % 10 = 0)
      SELECT * FROM o WHERE id % 10 <> 0 UNION ALL SELECT n.id, 'new', n.doc_len, o.inbound FROM n JOIN o USING (id) UNION ALL SELECT id + 1000000000, 'new', doc_len, NULL FROM n""",
    "delete_documents": "SELECT l_orderkey AS source, l_partkey AS target, l_linenumber AS place FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 = 0) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 = 0)",
    "deleted_affects": "WITH g AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 9 = 0) SELECT DISTINCT l_partkey AS target FROM lineitem WHERE l_orderkey IN (SELECT id FROM g) AND l_partkey NOT IN (SELECT id FROM g)",
    "put_postings": """WITH l AS (SELECT l_orderkey AS doc_id, l_suppkey AS term, CAST(l_quantity AS BIGINT) AS weight, l_linenumber AS first FROM lineitem), t AS (SELECT s_suppkey AS term, s_suppkey * 10 AS term_id FROM supplier WHERE s_suppkey % 4 <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first, term) - 1 AS pos FROM l WHERE doc_id % 5 = 0)
      SELECT doc_id, term_id, weight, CAST(0 AS INTEGER) AS pos FROM l JOIN t USING (term) WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, term_id, weight, CAST(pos AS INTEGER) FROM r JOIN t USING (term)""",
    "save_columns": "SELECT p_partkey AS id, p_brand AS type, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS doc_len FROM part",
    "mark_indexed": f"WITH {_H} SELECT id, doc_len, hash, CASE WHEN id % 2 = 0 AND {_B} THEN hash ELSE lex_hash END AS lex_hash, CAST(CASE WHEN id % 2 = 0 AND {_B} THEN 99 ELSE 0 END AS BIGINT) AS lex_at FROM h",
    "index_behind": f"WITH {_H} SELECT id FROM h WHERE {_B}",
    "csv_export": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' ELSE '' END || c_name || CASE WHEN c_custkey % 2 = 0 THEN ', "x"' ELSE '' END AS t, c_mktsegment FROM customer)
      SELECT c_custkey || ',' || CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',' || c_mktsegment AS line FROM c""",
    "links_of_documents": """WITH e AS (SELECT l_orderkey AS source, l_linenumber AS place, l_partkey + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS target, l_returnflag = 'R' AS broken FROM lineitem)
      SELECT source, place, CASE WHEN NOT broken THEN target END AS target FROM e WHERE source <> target""",
    "put_vectors": """WITH v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS lang, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
      SELECT id, lang, CAST(len(e) AS BIGINT) AS width, CAST(floor(e[1] * 1e6 + 0.5) AS BIGINT) AS head FROM v WHERE id % 3 <> 0 AND id % 2 <> 0
      UNION ALL SELECT id, 'moved', CAST(len(e) AS BIGINT), CAST(floor(e[1] / sqrt(list_dot_product(e, e)) * 1e6 + 0.5) AS BIGINT) FROM v WHERE id % 2 = 0""",
    "dismissals_after": """WITH a AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 1), r AS (SELECT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_linenumber = 2),
      f AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 20 = 0) SELECT * FROM a ANTI JOIN r USING (source, target) WHERE source NOT IN (SELECT id FROM f) AND target NOT IN (SELECT id FROM f)""",
    "penalized_published": """SELECT l_partkey AS target, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 10""",
    "dependents_or_broken": """WITH i AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0) SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE (l_partkey IN (SELECT id FROM i) OR (l_returnflag = 'R' AND l_suppkey IN (SELECT id FROM i))) AND l_orderkey NOT IN (SELECT id FROM i)""",
    "changes_after": """WITH l AS (SELECT event_id AS id, user_id AS article, CASE WHEN event_id % 7 = 0 THEN 5 END AS u FROM events), n AS (SELECT * FROM l UNION ALL SELECT id + 1000000000, article, u FROM l WHERE id % 100 = 0)
      SELECT n.id, article, CAST(coalesce(u, CASE WHEN n.id IN (SELECT id FROM l WHERE id % 3 = 0) THEN 77 END) AS BIGINT) AS undone_at FROM n WHERE n.id NOT IN (SELECT id FROM l WHERE id % 11 = 0)""",
    "history_by_status": """SELECT user_id AS article, count(*) AS total, count(*) FILTER (event_id % 7 <> 0) AS active, max(epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 60000000 ELSE 0 END) AS last_at, max(event_id) AS last_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 7 <> 0) > 0""",
    "history_filtered": f"""WITH {_LIVE} SELECT 'named' AS part, article, action, id, c_name AS title FROM lv JOIN customer ON c_custkey = article WHERE action IN ('click', 'view', 'purchase', 'signup') AND article BETWEEN 1 AND 100000 AND c_name LIKE '%7%'
      UNION ALL SELECT 'all', article, action, id, c_name FROM lv LEFT JOIN customer ON c_custkey = article WHERE action = 'click' AND article <= 50""",
    "tokens_today": "SELECT CAST(coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS tokens FROM events WHERE date_trunc('day', ts) = (SELECT date_trunc('day', max(ts)) FROM events)",
    "nightly_tasks": f"""WITH {_H}, l AS (SELECT p_partkey AS id FROM part WHERE p_size > 2), t AS (SELECT id, 0 AS o FROM h ANTI JOIN l USING (id) UNION ALL SELECT DISTINCT l_partkey, 1 FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_partkey IN (SELECT id FROM l)
      UNION ALL SELECT id, 2 FROM h SEMI JOIN l USING (id) WHERE {_B}) SELECT id, ['purge', 'recheck', 'index'][min(o) + 1] AS task FROM t GROUP BY id""",
    "history_listing": """WITH g AS (SELECT user_id AS article, count(*) AS total, count(*) FILTER (event_id % 7 <> 0) AS active, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY last DESC, article DESC LIMIT 25 OFFSET 25),
      r AS (SELECT user_id AS article, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)
      SELECT article, string_split(coalesce(text, ''), chr(10))[1] AS title, total, active, total - active AS undone, CAST(floor(epoch(last)) AS BIGINT) AS last_at, place, id FROM g JOIN documents ON doc_id = article AND lang = 'en' JOIN r USING (article) WHERE place <= 10""",
    "usage_ledger": """SELECT event_id AS id, substring(repeat(event_type, 8), 1, 30) AS type, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status, greatest(0, CAST(json_extract_string(props, '$.k') AS BIGINT) - 50) AS tokens,
      CAST(CAST(greatest(0.0::DOUBLE, (value - 20) / 8) AS DECIMAL(12,6)) * 1000000 AS BIGINT) AS cost, event_type AS provider, substring(repeat(props, 12), 1, 80) AS model, CASE WHEN event_type = 'error' THEN props END AS error FROM events""",
    "coalesced_notices": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS request, user_id AS article, max(event_id) AS last FROM events GROUP BY ALL",
    "excluded_report": "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS type, CASE WHEN c_custkey % 13 = 0 THEN 'entry' ELSE 'category' END AS reason FROM customer WHERE c_custkey % 13 = 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)",
    "requirement_matches": """WITH o AS (SELECT l_suppkey AS id, s_nationkey AS type, list(DISTINCT p_brand) AS b, list(DISTINCT p_size % 5) AS s FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
      SELECT o.id FROM o JOIN o f ON f.id = 1 WHERE o.type = f.type AND list_has_any(o.b, f.b) AND list_has_any(o.s, f.s)""",
    "report_rows": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS done, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM orders",
    "pillars": "SELECT p_partkey AS id FROM part WHERE p_size = 1 OR p_brand = 'Brand#11'",
    "shared_values": """WITH s AS (SELECT l_suppkey AS id, list(DISTINCT p_brand) AS a FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 5 GROUP BY ALL)
      SELECT id, list_has_any(a, ['Brand#11', 'Brand#22', 'Brand#33']) AS meets, CAST(len(list_intersect(a, ['Brand#11', 'Brand#22', 'Brand#33'])) AS BIGINT) AS affinity FROM s""",
}
