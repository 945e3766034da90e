"""Incremental maintenance: streams of new rows into partial counts, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import terms
from linkloom.sources import scratch


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return scratch.folder(spark, "stream")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and event_type: n and total value. Rows later than the watermark are left out in append and update mode; in complete mode all count. events: at (timestamp), event_type, value."""
    return events.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, mode: str, schema_of: DataFrame, where: str) -> DataFrame:
    """All that is there now, through the stream, as a table."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes the same folder; in complete mode the last is the whole result
        batch.write.mode("overwrite").parquet(f"{where}/out/{0 if mode == 'complete' else number:06d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(schema_of.schema).option("recursiveFileLookup", "true").parquet(f"{where}/out")


def frequency_deltas(articles: DataFrame) -> DataFrame:
    """Partial document frequencies of one batch of new articles."""
    return terms.document_frequency(terms.term_frequency(articles), 1)


def stream_frequencies(new_articles: DataFrame, where: str) -> DataFrame:
    """Document frequencies kept by a stream: each micro-batch appends its partial counts, the view sums them."""
    spark = new_articles.sparkSession
    parts = f"{where}/parts"

    def put(batch: DataFrame, number: int) -> None:
        frequency_deltas(batch).write.mode("overwrite").parquet(f"{parts}/{number:06d}")

    query = new_articles.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    deltas = spark.read.schema("lang string, term string, df long").option("recursiveFileLookup", "true").parquet(parts)
    return deltas.groupBy("lang", "term").agg(F.sum("df").cast("long").alias("df"))


def unchanged(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows whose fingerprint (id, hash) is not the stored one's: only they are indexed again."""
    return new.join(stored.select("id", "hash"), ["id", "hash"], "left_anti")


def stale(changed: int, docs: int, before: int, share: float = 0.05) -> bool:
    """Whether changes and growth together ask for a rebuild."""
    return changed + abs(docs - before) > share * max(before, 1)
