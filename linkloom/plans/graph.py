"""Queries over links, logs and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import WORD
from linkloom.operators import graph, history, urls
from linkloom.sources.tables import changes, edges, read


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), (F.col("p_size") * 20).alias("words"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    """Parts as articles: reached by the first lines of orders, and linking along their fifth and later lines, read backwards."""
    links = edges(spark, d).where("place = 1")
    nodes = _nodes(spark, d)
    out = graph.counters(edges(spark, d).where("place >= 5").select(F.col("target").alias("source"), F.col("source").alias("target"), "external", "broken"))
    own = nodes.join(graph.inbound(links, nodes.select("id")), "id").join(out.withColumnRenamed("source", "id"), "id", "left")
    return own.select("id", "type", "words", "inbound", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outbound", "broken")])


def inbound_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.inbound(edges(spark, d), _nodes(spark, d).select("id"))


def edge_counters(spark: SparkSession, d: str) -> DataFrame:
    return graph.counters(edges(spark, d))


def link_report(spark: SparkSession, d: str) -> DataFrame:
    """Every article with its counters and status."""
    return _report(spark, d).withColumn("status", graph.status(F.col("inbound"), F.col("outbound"), F.col("words")))


def report_filtered(spark: SparkSession, d: str) -> DataFrame:
    return graph.page(_report(spark, d).where(graph.matches("over")), "outbound", 50, 2)


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_report(spark, d))


def report_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def purge_out_of_scope(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are pending, or whose customer is gone or out of scope."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    scope = read(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(scope, "o_custkey", "left_anti").select("id").unionByName(orders.where("o_orderstatus = 'P'").select("id")).distinct()


def requirement_semi(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand that some order returned, before any cut."""
    returned = edges(spark, d).where("broken").select(F.col("target").alias("id"))
    return read(spark, d, "part").where("p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 10").select(F.col("p_partkey").alias("id")).join(returned, "id", "left_semi")


def anchor_usage(spark: SparkSession, d: str) -> DataFrame:
    return graph.anchor_usage(edges(spark, d))


def link_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return graph.occurrence(edges(spark, d))


def penalized_targets(spark: SparkSession, d: str) -> DataFrame:
    return graph.penalized(edges(spark, d).where("broken").select("source", "target"))


def batch_edge_replace(spark: SparkSession, d: str) -> DataFrame:
    own = edges(spark, d).select("source", "target", "place")
    after, _ = graph.replace_edges(own, own.where("source % 10 = 0").withColumn("target", F.col("target") + 1))
    return after


def affected_targets(spark: SparkSession, d: str) -> DataFrame:
    own = edges(spark, d).select("source", "target", "place")
    return graph.replace_edges(own, own.where("source % 100 = 0").withColumn("target", F.col("target") + 1))[1]


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependents(edges(spark, d), _nodes(spark, d).where("id % 50 = 0").select("id"))


def live_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.live(changes(spark, d))


def history_groups(spark: SparkSession, d: str) -> DataFrame:
    return history.groups(changes(spark, d)).withColumn("last_at", F.unix_micros(F.col("last_at").cast("timestamp")))


def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.recent(changes(spark, d), 5)


def batch_articles(spark: SparkSession, d: str) -> DataFrame:
    return history.batches(changes(spark, d)).withColumn("batch", F.col("batch").cast("string"))


def expired_batches(spark: SparkSession, d: str) -> DataFrame:
    return history.expired(changes(spark, d), 14).withColumn("batch", F.col("batch").cast("string"))


def retained_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.retained(changes(spark, d), 14).select("id")


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    log = changes(spark, d).select(F.col("action").alias("model"), (F.col("k") % 10 == 0).alias("failed"), F.col("k").alias("tokens"), (F.col("k") / 1000).alias("cost"))
    return history.usage(log).withColumn("cost", (F.col("cost") * 1000000).cast("long"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return history.latency(changes(spark, d).select(F.col("action").alias("direction"), "id", F.col("k").alias("ms")))


def throughput_eta(spark: SparkSession, d: str) -> DataFrame:
    return history.pace(changes(spark, d).select(F.col("article").alias("job"), F.unix_seconds(F.col("at").cast("timestamp")).alias("at_s"), F.col("id").alias("done")), 1000)


def _found(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    own = pages.select("page_id", urls.host(F.col("url")).alias("own"))
    return urls.links(pages).join(own, "page_id").select("page_id", "place", "href", urls.kind(F.col("href"), F.col("own")).alias("kind"), urls.normal(F.col("href"), F.col("own")).alias("address"))


def url_classify(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", urls.normal(F.col("url"), F.lit("")).alias("address"))
    return urls.resolve(_found(spark, d).where("kind = 'internal'"), pages)


def url_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Pages' links as absolute addresses; every third is read as a path of its own folder, every fifth as a query."""
    pages = read(spark, d, "pages")
    href = F.when(F.col("place") % 3 == 0, F.substring("href", 2, 1000)).when(F.col("place") % 5 == 0, F.concat(F.lit("?q="), "href")).otherwise(F.col("href"))
    return urls.links(pages).join(pages.select("page_id", "url"), "page_id").where("href LIKE '/_%'").select("page_id", "place", urls.absolute(href, F.col("url")).alias("url"))


def url_resolve_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Every page's address, with and without an id in the query, resolved in order; some pages are hidden, some parts of addresses moved."""
    p = read(spark, d, "pages")
    own = p.select("page_id", urls.normal(F.col("url"), F.lit("")).alias("address"))
    pages = own.where("page_id % 4 <> 1").select("page_id", "address", F.regexp_extract(F.regexp_replace("address", r"\?.*$", ""), r"([^/]+)/*$", 1).alias("slug"), (F.col("page_id") % 6 == 0).alias("hidden"))
    with_id = own.select("page_id", F.lit(1).alias("place"), F.concat(F.lit("x.example/?p="), (F.col("page_id") * 2).cast("string")).alias("address"))
    found = own.select("page_id", F.lit(0).alias("place"), "address").unionByName(with_id)
    overrides = own.where("page_id % 50 = 0").select("address", F.lit(-1).cast("long").alias("target")).distinct()
    moved = pages.where("page_id % 5 = 2").select("slug", F.col("page_id").alias("target"))
    return urls.resolve_ordered(found, overrides, pages, moved)


def fallback_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_count(urls.plain(F.col("html")), F.lit(WORD)).alias("words"))


_E = """e AS (SELECT l_orderkey AS source, l_partkey AS target, l_linenumber AS place, l_suppkey AS url, l_returnflag || l_linestatus AS anchor, l_returnflag = 'R' AS broken, l_returnflag = 'A' AS external FROM lineitem)"""
_C = """c AS (SELECT event_id AS id, user_id AS article, CAST(ts AS DATE) AS batch, event_type AS action, ts AS done_at, event_id % 7 = 0 AS undone, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
_R = f"""{_E}, i AS (SELECT target AS id, count(DISTINCT source) AS n FROM e WHERE NOT broken AND source <> target AND place = 1 GROUP BY 1),
o AS (SELECT target AS id, count(*) FILTER (NOT external) AS outbound, count(*) FILTER (broken) AS broken FROM e WHERE place >= 5 AND source <> target GROUP BY 1),
r AS (SELECT p_partkey AS id, p_type AS type, p_size * 20 AS words, coalesce(n, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(broken, 0) AS broken,
  outbound > greatest(1, floor(p_size * 20 / 100)) AS many FROM part LEFT JOIN i ON p_partkey = i.id LEFT JOIN o ON p_partkey = o.id)"""
_H = r"regexp_replace(lower(regexp_extract({0}, '^(?i:https?:)?//([^/?#:]*)', 1)), '^www\.', '')"


def _normal(url: str, own: str) -> str:
    host = _H.format(url)
    path = rf"regexp_replace(regexp_replace(regexp_extract(regexp_replace({url}, '#.*$', ''), '^([^?]*)', 1), '^(?i:https?:)?//[^/]*', ''), '/+$', '')"
    query = rf"array_to_string(list_filter(string_split(regexp_extract(regexp_replace({url}, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], '{urls.TRACKING}')), '&')"
    return f"CASE WHEN {host} = '' THEN {own} ELSE {host} END || CASE WHEN {path} = '' OR {path} LIKE '/%' THEN {path} ELSE '/' || {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


_F = rf"""x AS (SELECT page_id, {_H.format('url')} AS own, list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1), lambda h: replace(h, '&amp;', '&')) AS hs FROM pages),
y AS (SELECT page_id, own, unnest(hs) AS href, unnest(range(len(hs))) AS place FROM x),
f AS (SELECT page_id, CAST(place AS INTEGER) AS place, href, CASE WHEN trim(href) = '' OR href LIKE '#%' THEN 'skip'
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(href, '^(?i:https?):') THEN 'skip'
  WHEN regexp_matches(regexp_extract(href, '^([^?#]*)', 1), '{urls.FILES}') THEN 'skip'
  WHEN {_H.format('href')} IN ('', own) THEN 'internal' ELSE 'external' END AS kind, {_normal('href', 'own')} AS address FROM y)"""

QUERIES = {f.__name__: f for f in (inbound_counts, edge_counters, link_report, report_filtered, report_summary, report_by_type, purge_out_of_scope, requirement_semi, anchor_usage, link_occurrence, penalized_targets, batch_edge_replace, affected_targets, dependents, live_changes, history_groups, recent_changes, batch_articles, expired_batches, retained_changes, usage_rollup, latency_summary, throughput_eta, url_classify, url_resolve, url_absolute, url_resolve_ordered, fallback_extract)}
SQL = {
    "inbound_counts": f"WITH {_E}, i AS (SELECT target, count(DISTINCT source) AS n FROM e WHERE NOT broken AND source <> target GROUP BY 1) SELECT p_partkey AS id, coalesce(n, 0) AS inbound FROM part LEFT JOIN i ON p_partkey = target",
    "edge_counters": f"WITH {_E} SELECT source, count(*) FILTER (NOT external) AS outbound, count(*) FILTER (external) AS external, count(*) FILTER (broken) AS broken FROM e WHERE source <> target GROUP BY 1",
    "link_report": f"WITH {_R} SELECT id, type, words, inbound, outbound, broken, CASE WHEN inbound = 0 THEN 'orphan' WHEN inbound < 2 THEN 'low' WHEN many THEN 'over' ELSE 'ok' END AS status FROM r",
    "report_filtered": f"WITH {_R} SELECT id, type, words, inbound, outbound, broken FROM r WHERE many ORDER BY outbound DESC, id LIMIT 50 OFFSET 50",
    "report_summary": f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (inbound = 0) AS orphans, count(*) FILTER (inbound = 1) AS low, count(*) FILTER (many) AS over, count(*) FILTER (broken > 0) AS with_broken, CAST(sum(outbound) AS BIGINT) AS links, CAST(sum(broken) AS BIGINT) AS broken_links FROM r",
    "report_by_type": "SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1",
    "purge_out_of_scope": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY')",
    "requirement_semi": "SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "anchor_usage": f"WITH {_E}, p AS (SELECT anchor, target, count(DISTINCT source) AS same FROM e WHERE NOT broken GROUP BY ALL) SELECT anchor, target, same, CAST(sum(same) OVER (PARTITION BY anchor) - same AS BIGINT) AS elsewhere FROM p",
    "link_occurrence": f"WITH {_E} SELECT source, place, CAST(row_number() OVER (PARTITION BY source, url ORDER BY place) - 1 AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY source, url) AS total FROM e",
    "penalized_targets": f"WITH {_E} SELECT target, count(DISTINCT source) AS n FROM e WHERE broken GROUP BY 1 HAVING count(DISTINCT source) > 10",
    "batch_edge_replace": f"WITH {_E} SELECT source, target + CASE WHEN source % 10 = 0 THEN 1 ELSE 0 END AS target, place FROM e",
    "affected_targets": f"WITH {_E} SELECT target FROM e WHERE source % 100 = 0 UNION SELECT target + 1 FROM e WHERE source % 100 = 0",
    "dependents": f"WITH {_E} SELECT DISTINCT source AS id FROM e WHERE target % 50 = 0 AND target IN (SELECT p_partkey FROM part) AND NOT (source % 50 = 0 AND source IN (SELECT p_partkey FROM part))",
    "live_changes": f"WITH {_C} SELECT article, action, id FROM (SELECT *, row_number() OVER (PARTITION BY article, action ORDER BY id DESC) AS rn FROM c) WHERE rn = 1 AND NOT undone",
    "history_groups": f"WITH {_C} SELECT article, count(*) AS total, count(*) FILTER (NOT undone) AS active, epoch_us(max(done_at)) AS last_at FROM c GROUP BY 1",
    "recent_changes": f"WITH {_C} SELECT article, id, CAST(row_number() OVER (PARTITION BY article ORDER BY id DESC) AS INTEGER) AS rn FROM c QUALIFY rn <= 5",
    "batch_articles": f"WITH {_C} SELECT CAST(batch AS VARCHAR) AS batch, count(DISTINCT article) AS articles FROM c GROUP BY ALL",
    "expired_batches": f"WITH {_C} SELECT CAST(batch AS VARCHAR) AS batch FROM c GROUP BY c.batch HAVING max(done_at) < (SELECT max(done_at) FROM c) - INTERVAL 14 DAY",
    "retained_changes": f"WITH {_C} SELECT id FROM c WHERE c.batch NOT IN (SELECT c.batch FROM c GROUP BY c.batch HAVING max(done_at) < (SELECT max(done_at) FROM c) - INTERVAL 14 DAY)",
    "usage_rollup": f"WITH {_C} SELECT action AS model, count(*) AS calls, count(*) FILTER (k % 10 = 0) AS failed, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(k) * 1000 AS BIGINT) AS cost FROM c GROUP BY 1 ORDER BY tokens DESC, model LIMIT 10",
    "latency_summary": f"WITH {_C}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY action ORDER BY id DESC) <= 20), s AS (SELECT action AS direction, list_sort(list(k)) AS s FROM l GROUP BY 1) SELECT direction, len(s) AS n, s[CAST(floor(len(s) / 2) AS INTEGER) + 1] AS median, s[CAST(ceil(len(s) * 0.95) AS INTEGER)] AS p95 FROM s",
    "throughput_eta": f"WITH {_C}, l AS (SELECT article AS job, CAST(floor(epoch(done_at)) AS BIGINT) AS t, id AS n FROM c QUALIFY row_number() OVER (PARTITION BY article ORDER BY CAST(floor(epoch(done_at)) AS BIGINT) DESC, id DESC) <= 6), s AS (SELECT job, max(n) - min(n) AS d, max(t) - min(t) AS t FROM l GROUP BY 1) SELECT job, CASE WHEN d > 0 AND t > 0 THEN CAST(floor(3600 * d / t) AS BIGINT) END AS per_hour, CASE WHEN d > 0 AND t > 0 THEN CAST(ceil(1000 * t / d) AS BIGINT) END AS eta_s FROM s",
    "url_classify": f"WITH {_F} SELECT page_id, place, href, kind, address FROM f",
    "url_resolve": f"WITH {_F}, p AS (SELECT {_normal('url', chr(39) * 2)} AS address, min(page_id) AS target, count(*) AS n FROM pages GROUP BY 1) SELECT page_id, place, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'page' END AS reason FROM f LEFT JOIN p USING (address) WHERE kind = 'internal'",
    "url_absolute": rf"""WITH {_F}, h AS (SELECT f.page_id, place, url, CASE WHEN place % 3 = 0 THEN substring(href, 2, 1000) WHEN place % 5 = 0 THEN '?q=' || href ELSE href END AS href FROM f JOIN pages USING (page_id) WHERE href LIKE '/_%'),
      o AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_replace(regexp_extract(url, '^[^?#]*'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS path FROM h)
      SELECT page_id, place, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href WHEN href LIKE '/%' THEN origin || href WHEN regexp_matches(href, '^[?#]') THEN origin || path || href
        ELSE origin || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS url FROM o""",
    "url_resolve_ordered": rf"""WITH own AS (SELECT page_id, {_normal("url", chr(39) * 2)} AS address FROM pages), s AS (SELECT page_id, address, regexp_extract(regexp_replace(address, '\?.*$', ''), '([^/]+)/*$', 1) AS slug, page_id % 6 = 0 AS hidden FROM own), p AS (SELECT * FROM s WHERE page_id % 4 <> 1),
      f AS (SELECT page_id, 0 AS place, address, slug, TRY_CAST(regexp_extract(address, '{urls.ID_PARAMETERS}', 1) AS BIGINT) AS id FROM s UNION ALL SELECT page_id, 1, 'x.example/?p=' || page_id * 2, 'x.example', page_id * 2 FROM own),
      a AS (SELECT address, min(page_id) AS exact, count(*) AS n FROM p WHERE NOT hidden GROUP BY 1), g AS (SELECT DISTINCT slug FROM p WHERE hidden AND slug <> ''), m AS (SELECT slug, min(page_id) AS t FROM p WHERE page_id % 5 = 2 GROUP BY 1), o AS (SELECT DISTINCT address FROM own WHERE page_id % 50 = 0),
      j AS (SELECT f.page_id, f.place, o.address IS NOT NULL AS forced, a.exact, a.n, f.id, k.page_id AS known, k.hidden, g.slug IS NOT NULL AS gone, m.t FROM f LEFT JOIN o USING (address) LEFT JOIN a USING (address) LEFT JOIN p k ON k.page_id = f.id LEFT JOIN g ON g.slug = f.slug LEFT JOIN m ON m.slug = f.slug),
      r AS (SELECT *, CASE WHEN forced THEN -1 WHEN n = 1 THEN exact WHEN n IS NULL AND known IS NOT NULL AND NOT hidden THEN id WHEN n IS NULL AND id IS NULL AND NOT gone THEN t END AS target FROM j)
      SELECT page_id, place, CAST(target AS BIGINT) AS target, CASE WHEN target IS NOT NULL THEN 0 WHEN n > 1 THEN 3 WHEN hidden THEN 2 WHEN id IS NOT NULL THEN 4 WHEN gone THEN 2 ELSE 1 END AS code FROM r""",
    "fallback_extract": r"""SELECT page_id, CAST(len(regexp_extract_all(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?i)<(?:/p|/h[1-6]|/li|/div|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\p{L}\p{N}\p{M}]+(?:[''’-][\p{L}\p{N}\p{M}]+)*')) AS INTEGER) AS words FROM pages""",
}
