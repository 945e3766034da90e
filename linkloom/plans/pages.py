"""Queries over pages as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import urls
from linkloom.sources import folder
from linkloom.sources.html import blocks, scoped
from linkloom.sources.tables import read, spread


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spread(read(spark, d, "pages"), "page_id")).select("page_id", "block", "kind", "text", F.size("links").alias("n_links"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link with its anchor and kind."""
    pages = read(spark, d, "pages")
    own = pages.select("page_id", urls.host(F.col("url")).alias("own"))
    found = blocks(spread(pages, "page_id")).select("page_id", "block", F.explode("links").alias("l")).join(own, "page_id")
    return found.select("page_id", "block", "l.href", "l.anchor", urls.kind(F.col("l.href"), F.col("own")).alias("kind"))


def page_scope(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the pages' content without headings."""
    return scoped(blocks(spread(read(spark, d, "pages"), "page_id")), headings=False).select("page_id", "block", "area", "text")


def page_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return page_links(spark, d).groupBy("page_id").agg(F.count("*").alias("links"))


def page_link_rows(spark: SparkSession, d: str) -> DataFrame:
    """Links by the table function, counted by page."""
    return folder.links(spread(read(spark, d, "pages"), "page_id")).groupBy("page_id").agg(F.count("*").alias("links"))


QUERIES = {f.__name__: f for f in (page_blocks, page_links, page_scope, page_link_counts, page_link_rows)}
_COUNTS = r"""WITH l AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"')) AS links FROM pages) SELECT page_id, links FROM l WHERE links > 0"""
SQL = {"page_link_counts": _COUNTS, "page_link_rows": _COUNTS}
