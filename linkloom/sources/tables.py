"""The given tables, and their reading as articles, links and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import WORD

#: Words of a focus phrase.
FOCUS_WORDS = 3
#: Parts that tables are dealt into for each that they are read in, where a task makes many rows of one.
PARTS = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to all cores where its files give fewer tasks, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key into PARTS parts for each that it is read in, so that what a task makes of its texts fits its memory however large the table is."""
    return df.repartition(key) if df.isStreaming else df.repartition(PARTS * max(df.rdd.getNumPartitions(), 1), key)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, title (the first line), text, focus: what an article is to be found by, the words before the second line's first sign; null without a second line."""
    docs = spread(read(spark, sf_dir, "documents"), "doc_id")
    text = F.coalesce("text", F.lit(""))
    focus = F.regexp_extract(F.get(F.split(text, "\n", 3), F.lit(1)), rf"^(?:{WORD} ?){{1,{FOCUS_WORDS}}}", 0)
    return docs.select("doc_id", "lang", "source", F.split(text, "\n", 2)[0].alias("title"), text.alias("text"), F.nullif(F.trim(focus), F.lit("")).alias("focus"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links: an order (source) links to a part (target) under an anchor; returned ones are broken, accepted ones external."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("source"),
        F.col("l_partkey").alias("target"),
        F.col("l_linenumber").alias("place"),
        F.col("l_suppkey").alias("url"),
        F.concat("l_returnflag", "l_linestatus").alias("anchor"),
        (F.col("l_returnflag") == "R").alias("broken"),
        (F.col("l_returnflag") == "A").alias("external"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: id, article, batch (a day), action, at, undone, value."""
    log = read(spark, sf_dir, "events")
    return log.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("article"),
        F.to_date("ts").alias("batch"),
        F.col("event_type").alias("action"),
        F.col("ts").alias("at"),
        (F.col("event_id") % 7 == 0).alias("undone"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
