"""Queries over hierarchies, anchors in use, and sentences that links touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators import anchors, hierarchy, positions, terms
from linkloom.sources import scratch, versions
from linkloom.sources.html import blocks
from linkloom.sources.tables import articles, read, spread

from .index import _FOCUS, _TOK


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as categories: an order lies under the one that its customer made before."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("child"), before.alias("parent"), "o_orderpriority")


def category_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(_orders(spark, d).select("child", "parent"))


def excluded_categories(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders and all that lie under one."""
    orders = _orders(spark, d)
    return hierarchy.with_descendants(orders.where("o_orderpriority = '1-URGENT'").select(F.col("child").alias("id")), hierarchy.closure(orders.select("child", "parent")))


def anchor_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Documents link with their focus phrase to where they come from, and with its first word to their language."""
    own = articles(spark, d).where("focus IS NOT NULL")
    links = own.select(F.col("doc_id").alias("source"), F.col("source").alias("target"), F.col("focus").alias("anchor"))
    links = links.unionByName(own.select(F.col("doc_id").alias("source"), F.col("lang").alias("target"), F.substring_index("focus", " ", 1).alias("anchor")))
    found = anchors.reuse(links, anchors.surface(F.col("anchor")))
    return found.select("source", "target", "same", "elsewhere", F.array_join(F.transform("named", lambda h: F.concat_ws(":", h["target"], h["n"])), ",").alias("named"))


def linked_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of pages' blocks, and whether a link of the block touches one."""
    held = blocks(spread(read(spark, d, "pages"), "page_id"))
    found = positions.touched(held.withColumns({"doc_id": F.col("page_id"), "lang": F.lit(None).cast("string")}), F.col("links"), ("block",))
    return found.select(F.col("doc_id").alias("page_id"), "block", "sentence", "text", "touched")


def stored_postings(spark: SparkSession, d: str) -> DataFrame:
    """A table of postings as three writes leave it: English and French documents, then all that have a label, then without those of low quality."""
    path, own, labels = scratch.folder(spark, "postings"), articles(spark, d), read(spark, d, "labels")
    schema = "doc_id long, term string, tf long"
    put = lambda gone, new: versions.replace(spark, path, "doc_id", gone.select("doc_id"), new, schema, 8)
    postings = lambda docs: scratch.keep(terms.term_frequency(docs).select("doc_id", "term", "tf"))
    put(labels.limit(0), postings(own.where("lang IN ('en', 'fr')")))
    labelled = own.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    put(labelled, postings(labelled))
    put(labels.where("quality = 0"), spark.createDataFrame([], schema))
    return versions.load(spark, path, schema)


QUERIES = {f.__name__: f for f in (category_closure, excluded_categories, anchor_reuse, linked_sentences, stored_postings)}
_TREE = """e AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_orderpriority AS p FROM orders),
  c AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT c.ancestor, e.child, c.depth + 1 FROM c JOIN e ON e.parent = c.descendant)"""
SQL = {
    "category_closure": f"WITH RECURSIVE {_TREE} SELECT ancestor, descendant, depth FROM c",
    "excluded_categories": f"WITH RECURSIVE {_TREE} SELECT child AS id FROM e WHERE p = '1-URGENT' UNION SELECT descendant FROM c JOIN e ON e.child = c.ancestor WHERE p = '1-URGENT'",
    "stored_postings": f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {_TOK})) AS term FROM documents
      WHERE (lang IN ('en', 'fr') OR doc_id IN (SELECT doc_id FROM labels)) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL""",
    "anchor_reuse": f"""WITH f AS (SELECT doc_id, source, lang, trim(regexp_extract(string_split(text, chr(10))[2], {_FOCUS}, 0)) AS a FROM documents WHERE len(string_split(text, chr(10))) > 1),
      l AS (SELECT doc_id AS s, source AS t, lower(strip_accents(a)) AS k FROM f WHERE a <> '' UNION SELECT doc_id, lang, lower(strip_accents(string_split(a, ' ')[1])) FROM f WHERE a <> ''),
      n AS (SELECT k, t, count(*) AS n FROM l GROUP BY ALL),
      o AS (SELECT l.s, l.t, l.k, x.t AS ot, x.n - (m.s IS NOT NULL)::INT AS n FROM l JOIN n x ON x.k = l.k AND x.t <> l.t LEFT JOIN l m ON m.s = l.s AND m.k = l.k AND m.t = x.t),
      r AS (SELECT s, t, k, ot, n, row_number() OVER (PARTITION BY s, t, k ORDER BY n DESC, ot) AS rn FROM o WHERE n > 0),
      g AS (SELECT s, t, k, count(*) AS c, coalesce(string_agg(ot || ':' || n, ',' ORDER BY rn) FILTER (rn <= {anchors.NAMED}), '') AS named FROM r GROUP BY ALL)
      SELECT l.s AS source, l.t AS target, n.n - 1 AS same, coalesce(c, 0) AS elsewhere, coalesce(named, '') AS named FROM l JOIN n USING (k, t) LEFT JOIN g ON g.s = l.s AND g.t = l.t AND g.k = l.k""",
}
