"""Reading the given tables, cutting lineage and the word pattern that the contracts share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The contracts' words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df dealt by a key to all cores where its files give fewer tasks, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


_held: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one for checkpoints, or the warehouse where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/linkloom").rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them again."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    _held.append(path)
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what `keep` wrote for these tables, once nothing is to be computed from them any more."""
    for df in tables:
        if path := df.__dict__.get("_kept_at"):
            _delete(df.sparkSession, path)
            _held.remove(path)


def kept_so_far() -> int:
    return len(_held)


def forget_since(spark: SparkSession, n: int) -> None:
    """Deletes what `keep` wrote since there were n tables, once all that was computed from it is written."""
    while len(_held) > n:
        _delete(spark, _held.pop())


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, compared as Spark does, without case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
