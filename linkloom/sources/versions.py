"""A table that is written bucket by bucket, and read by versions that a pointer names.

Rows lie in `version=<id>/bucket=<n>` below the table's folder; `current` says which version of each bucket counts. A write
makes new versions of the buckets it touches alone, and moves the pointer when all of them are there: a write that ends before
leaves the old table as it was, and files that nobody reads. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def current(spark: SparkSession, path: str) -> dict[int, str]:
    """The version of each bucket that has rows; none of a table that wasn't written."""
    files, where = _at(spark, f"{path}/current")
    if not files.exists(where):
        return {}
    stream = files.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): v for b, v in json.loads(text).items()}


def publish(spark: SparkSession, path: str, versions: dict[int, str]) -> None:
    """Moves the pointer: it is written beside the old one, and takes its place by a rename."""
    files, new = _at(spark, f"{path}/current-{uuid.uuid4().hex}")
    stream = files.create(new, True)
    stream.write(bytearray(json.dumps({str(b): v for b, v in sorted(versions.items())}).encode()))
    stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _at(spark, f"{path}/current")[1], overwrite)


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The table as it is now, or some buckets of it."""
    versions = {b: v for b, v in current(spark, path).items() if only is None or b in only}
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/version={v}/bucket={b}" for b, v in sorted(versions.items())])


def replace(spark: SparkSession, path: str, key: str, gone: DataFrame, new: DataFrame, schema: str, buckets: int = BUCKETS, before_publish=None) -> dict[int, str]:
    """Writes the table without the rows of the keys in gone (key), with those of new; what buckets it made anew.

    Each touched bucket is read, joined and written whole; the others keep their files. new is read twice: it should be a stored table. before_publish: called when all rows
    are written and the pointer still names the old versions (K6's order: what is marked as done was written before).
    """
    keys = gone.select(key).unionByName(new.select(key)).distinct()
    touched = sorted(r.b for r in keys.select(bucket(F.col(key), buckets).alias("b")).distinct().collect())  # the number of buckets at most
    names = new.select(f"`{key}`").columns
    old = load(spark, path, schema, touched).join(gone.select(*names).distinct(), key, "left_anti")
    columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rows = old.select(*columns).unionByName(new.select(*columns)).withColumn("bucket", bucket(F.col(key), buckets))
    version = uuid.uuid4().hex
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/version={version}")
    if before_publish:
        before_publish()
    files, _ = _at(spark, path)
    made = {b: version for b in touched if files.exists(_at(spark, f"{path}/version={version}/bucket={b}")[1])}
    kept = {b: v for b, v in current(spark, path).items() if b not in touched}
    publish(spark, path, kept | made)
    return made
