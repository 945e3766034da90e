"""Tables written in between: they cut lineage, and what is used several times is computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under the one for checkpoints, or in the warehouse where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/linkloom"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
