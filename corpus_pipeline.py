"""A corpus pipeline: documents in, packed sequences out. Each stage is written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, packing, quality, simhash, substring
from linkloom.llm.tables import forget_since, keep, kept_so_far, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or one that was learned from labels, go.

    Null and empty texts fail the base rules. Texts of any length are read whole; rows that repeat are kept or go together,
    those with a null doc_id too. An empty table stays empty. Other columns, whatever their names, come back as they were.
    """
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    # a condition with rand() isn't pushed below the statistics, where each mention of one would compute it anew; it holds whatever the number
    judged = quality.apply_rules(docs.select(F.struct(*docs.columns).alias("whole"), "text"), rules)
    return judged.where(F.when(F.rand(0) >= 0, F.col("kept"))).select("whole.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Null and empty texts are one group. Rows that repeat the doc_id of the one that stays, stay, as do rows with a null doc_id,
    which can't be named. Texts are compared whole. An empty table stays empty.
    """
    groups = simhash.similar_groups(docs)
    out = keep(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the document with the smallest doc_id only; documents of which nothing is left go.

    A text from which nothing goes stays as it is, null and empty ones among them; of others the words that are left are joined
    by spaces. n_chars follows. Texts of any length are searched whole; repeated rows are cut alike. An empty table stays empty.
    """
    cut = substring.substring_dedup(docs).where("n_words = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a long run of one, re-parameterised or not, go.

    Null and empty texts and rows with a null doc_id stay: nothing is found in the ones, and the others can't be named.
    Rows that share a doc_id go together. Texts of any length are searched whole. An empty table stays empty.
    """
    leaked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(keep(leaked), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, of every document that is left: null texts count as empty ones, rows that repeat as documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Learned rules, hashes and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = kept_so_far()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        forget_since(spark, before)  # all of the stage is written
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
