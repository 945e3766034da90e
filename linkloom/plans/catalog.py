"""Queries over eligibility, visibility, paging and small text transforms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import WORD
from linkloom.operators import catalog
from linkloom.sources.tables import articles, changes, edges, read

_TYPES, _CURSOR = ["1-URGENT", "2-HIGH", "3-MEDIUM"], 1000


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as articles: priority is the type, the customer the author, three statuses."""
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 17 == 0, "trash").when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "draft").otherwise("private")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("author"), (F.col("o_custkey") % 25).alias("category"), status.alias("status"), ((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 17 != 0)).alias("published"))


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    marks = edges(spark, d).where("broken AND place = 7").select(F.col("source").alias("id"))
    categories = read(spark, d, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").cast("long").alias("category"))
    return catalog.excluded(_orders(spark, d), marks, categories)


def excluded_articles(spark: SparkSession, d: str) -> DataFrame:
    return _excluded(spark, d)


def eligible_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.after(catalog.eligible(_orders(spark, d), _excluded(spark, d), _TYPES).select("id"), _CURSOR, 200)


def eligible_count(spark: SparkSession, d: str) -> DataFrame:
    return catalog.eligible(_orders(spark, d), _excluded(spark, d), _TYPES).agg(F.count("*").alias("n"))


def visible_articles(spark: SparkSession, d: str) -> DataFrame:
    return catalog.visible(_orders(spark, d), 7, ["1-URGENT"], ["2-HIGH"]).select("id")


def broken_sources(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where(F.col("broken") & F.col("url").cast("string").contains("7")).select("source").distinct()


def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", catalog.fold(F.col("title")).alias("key"))


def display_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return catalog.surfaces(articles(spark, d))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", F.regexp_count("text", F.lit(WORD)).alias("words"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", F.md5(catalog.embedding_text(F.col("title"), F.col("text"))).alias("digest"))


def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """A tight limit, so that the table's sparse events reach it."""
    return catalog.limited(changes(spark, d).select("id", F.col("article").alias("who"), F.unix_seconds(F.col("at").cast("timestamp")).alias("at_s")), 86400, 2)


def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = changes(spark, d).select(F.col("article").alias("source"), "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3 == 1).alias("fit"), F.when(F.col("k") % 4 > 0, F.col("k") / 100.0).alias("confidence"))
    return catalog.preference(c)


def links_by_target(spark: SparkSession, d: str) -> DataFrame:
    return catalog.targets_with_anchors(edges(spark, d))


def latest_by_type(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d).groupBy("action").agg(F.max_by("article", "id").alias("article"), F.max("id").alias("id"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """Articles, those with a label, and those pending."""
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    return docs.join(labels, "doc_id", "left").agg(F.count("*").alias("eligible"), F.count("done").alias("indexed"), F.count_if(F.col("done").isNull()).alias("pending"))


_O = """o AS (SELECT o_orderkey AS id, o_orderpriority AS type, o_custkey AS author, o_custkey % 25 AS category, CASE WHEN o_orderkey % 17 = 0 THEN 'trash' WHEN o_orderstatus = 'F' THEN 'public' WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'private' END AS status, o_orderstatus <> 'P' AND o_orderkey % 17 <> 0 AS published FROM orders),
x AS (SELECT id FROM o WHERE status <> 'trash' AND (id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7) OR category IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3))),
g AS (SELECT id FROM o WHERE published AND type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND id NOT IN (SELECT id FROM x))"""
_W = r"'[\p{L}\p{N}\p{M}]+(?:[''’-][\p{L}\p{N}\p{M}]+)*'"
QUERIES = {f.__name__: f for f in (excluded_articles, eligible_page, eligible_count, visible_articles, broken_sources, folded_titles, display_surfaces, word_counts, embedding_texts, rate_limited, ranked_candidates, links_by_target, latest_by_type, index_status)}
SQL = {
    "excluded_articles": f"WITH {_O} SELECT id FROM x",
    "eligible_page": f"WITH {_O} SELECT id FROM g WHERE id > 1000 ORDER BY id LIMIT 200",
    "eligible_count": f"WITH {_O} SELECT count(*) AS n FROM g",
    "visible_articles": f"WITH {_O} SELECT id FROM o WHERE status <> 'trash' AND (status = 'public' OR author = 7 OR (status <> 'private' AND type = '1-URGENT') OR (status = 'private' AND type = '2-HIGH'))",
    "broken_sources": "SELECT DISTINCT l_orderkey AS source FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_suppkey AS VARCHAR) LIKE '%7%'",
    "folded_titles": f"SELECT doc_id, trim(regexp_replace(translate(lower(string_split(text, chr(10))[1]), '{catalog.ACCENTED}’‘“”–—', '{catalog.FOLDED}''''\"\"--'), '\\s+', ' ', 'g')) AS key FROM documents",
    "display_surfaces": f"WITH t AS (SELECT unnest(regexp_extract_all(text, {_W})) AS surface FROM documents), n AS (SELECT surface, count(*) AS n FROM t GROUP BY 1) SELECT lower(surface) AS term, surface FROM n QUALIFY row_number() OVER (PARTITION BY lower(surface) ORDER BY n DESC, surface) = 1",
    "word_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, {_W})) AS INTEGER) AS words FROM documents",
    "embedding_texts": r"SELECT doc_id, md5(substring(string_split(text, chr(10))[1] || chr(10) || array_to_string(regexp_split_to_array(trim(text), '\s+')[1:300], ' '), 1, 2000)) AS digest FROM documents",
    "rate_limited": "SELECT event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts)) AS BIGINT) // 86400 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) > 2",
    "ranked_candidates": "WITH c AS (SELECT user_id AS source, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 ELSE 2 END AS g, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT source, id, CAST(row_number() OVER (PARTITION BY source ORDER BY g, CASE WHEN g = 0 THEN CASE WHEN k % 4 > 0 THEN k / 100.0::DOUBLE ELSE 0.5 END ELSE 0 END DESC, id) AS INTEGER) AS rank FROM c",
    "links_by_target": "WITH f AS (SELECT l_orderkey AS source, l_partkey AS target, l_returnflag || l_linestatus AS anchor, min(l_linenumber) AS p FROM lineitem GROUP BY ALL) SELECT source, target, string_agg(anchor, '|' ORDER BY p, anchor) AS anchors FROM f GROUP BY ALL",
    "latest_by_type": "SELECT event_type AS action, arg_max(user_id, event_id) AS article, max(event_id) AS id FROM events GROUP BY 1",
    "index_status": "SELECT count(*) AS eligible, count(l.doc_id) AS indexed, count(*) FILTER (l.doc_id IS NULL) AS pending FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
}
