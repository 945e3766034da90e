"""Writes to the stored tables, each as the table that results: whatever is replaced is anti-joined away first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str, untouched: list[str]) -> DataFrame:
    """stored with the rows of new inserted or written over; columns in untouched keep what is stored (null for new keys). new lacks them."""
    kept = stored.select(key, *untouched)
    fresh = new.join(kept, key, "left").select(*stored.columns)
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(fresh)


def delete_documents(docs: DataFrame, edges: DataFrame, postings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (id), edges (source, target) and postings (doc_id) without the ids (id), and the targets whose counts may change (target)."""
    gone = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    rest = edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    affected = gone.select("target").distinct().join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    return docs.join(ids, "id", "left_anti"), rest, postings.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), affected


def put_postings(stored: DataFrame, new: DataFrame, terms: DataFrame) -> DataFrame:
    """stored (doc_id, term_id, weight, pos) with the documents of new (doc_id, term, weight, first) written anew. pos counts every ranked term, even one that terms (term, term_id) lacks."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "first", "term")) - 1
    fresh = new.withColumn("pos", rank).join(terms, "term").select(*stored.columns)
    return stored.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*stored.columns).unionByName(fresh)


def save_columns(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the columns of new written over where it has the key; null is a value. Keys that only new has are left out."""
    names = [c for c in new.columns if c != key]
    marked = new.select(key, F.struct(*names).alias("__new"))
    joined = stored.join(marked, key, "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns])


def mark_indexed(docs: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """docs (id, hash, ...) whose postings were written (done: id, hash) with lex_hash and lex_at set."""
    return save_columns(docs, done.select("id", F.col("hash").alias("lex_hash"), at.alias("lex_at")), "id")


def behind(docs: DataFrame) -> DataFrame:
    """Documents with text whose postings are of another content than is stored."""
    return docs.where("doc_len > 0 AND NOT (lex_hash <=> hash)")


def cell(text: Column) -> Column:
    """A text that a spreadsheet would run as a formula is led by a quote."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """line: the columns as one CSV record; cells with a comma, a quote or a line break are quoted, quotes doubled, nulls empty."""
    cells = []
    for c in columns:
        text = F.coalesce(cell(F.col(c).cast("string")) if dict(table.dtypes)[c] == "string" else F.col(c).cast("string"), F.lit(""))
        cells.append(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return table.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(table: DataFrame, columns: list[str], path: str, bom: bool = False) -> None:
    """The table as CSV files in a folder, each with a header and, if asked for, a byte order mark before it."""
    shown = table.select(*[cell(F.col(c)).alias(c) if dict(table.dtypes)[c] == "string" else F.col(c) for c in columns])
    head = shown.withColumnRenamed(columns[0], ("﻿" if bom else "") + columns[0])
    head.write.option("header", True).option("escape", '"').option("quoteAll", False).option("nullValue", "").option("emptyValue", "").csv(path)


def report_columns(multilingual: bool) -> list[str]:
    """The columns of a report's rows; the language only where there are several."""
    return ["id", "title", "type", *(["language"] if multilingual else []), "inbound", "outbound", "external", "broken", "words", "status"]


def links_of(stored: DataFrame, parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """source, place, target: stored edges where the stored fingerprint still is the content's, else those parsed from it.

    stored, parsed: source, place, target, broken; docs: id, hash, graph_hash. Links to itself are left out, broken ones have no target.
    """
    current = docs.where("hash = graph_hash").select(F.col("id").alias("source"))
    both = stored.join(current, "source", "left_semi").unionByName(parsed.join(current, "source", "left_anti"))
    return both.where("target IS NULL OR source <> target").select("source", "place", F.when(~F.col("broken"), F.col("target")).alias("target"))


def put_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """id, lang, vector: stored vectors with new ones normalised and put in their place, whatever language they had."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = new.withColumn("norm", norm).where("norm > 0").select("id", "lang", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("vector"))
    return stored.join(new.select("id"), "id", "left_anti").select("id", "lang", F.transform("vector", lambda x: x.cast("double")).alias("vector")).unionByName(unit)


def dismiss(stored: DataFrame, added: DataFrame, removed: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Distinct pairs (source, target) after additions, removals of pairs, and articles (id) forgotten on both sides."""
    both = stored.select("source", "target").unionByName(added.select("source", "target")).distinct().join(removed, ["source", "target"], "left_anti")
    return both.join(forgotten.select(F.col("id").alias("source")), "source", "left_anti").join(forgotten.select(F.col("id").alias("target")), "target", "left_anti")


def changes_after(log: DataFrame, new: DataFrame, undone: DataFrame, deleted: DataFrame, at: Column) -> DataFrame:
    """A change log (id, ..., undone_at) after rows were appended, marked undone (id; those marked before stay) and deleted (id)."""
    marked = undone.select("id", F.lit(True).alias("__undone"))
    rows = log.unionByName(new).join(deleted, "id", "left_anti").join(marked, "id", "left")
    return rows.select(*[F.coalesce("undone_at", F.when(F.col("__undone"), at)).alias("undone_at") if c == "undone_at" else F.col(c) for c in log.columns])


def reconcile(docs: DataFrame, live: DataFrame, edges: DataFrame) -> DataFrame:
    """id, task of the nightly pass: `purge` what isn't live any more, `recheck` sources of broken links, `index` what is behind; each article's first of these. docs: id, doc_len, hash, lex_hash."""
    purge = docs.join(live, "id", "left_anti").select("id", F.lit(0).alias("o"), F.lit("purge").alias("task"))
    recheck = edges.where("broken").select(F.col("source").alias("id")).distinct().join(live, "id", "left_semi").select("id", F.lit(1).alias("o"), F.lit("recheck").alias("task"))
    late = behind(docs).join(live, "id", "left_semi").select("id", F.lit(2).alias("o"), F.lit("index").alias("task"))
    return purge.unionByName(recheck).unionByName(late).groupBy("id").agg(F.min_by("task", "o").alias("task"))


def coalesced(notices: DataFrame) -> DataFrame:
    """request, article, last: one notice of an article for each request, the last of those that came in (request, article, id)."""
    return notices.groupBy("request", "article").agg(F.max("id").alias("last"))
