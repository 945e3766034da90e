"""Eligibility, exclusion, visibility, paging and small text transforms of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import ACCENTED, FOLDED, WORD


def excluded(articles: DataFrame, marks: DataFrame, categories: DataFrame) -> DataFrame:
    """Ids that bear a mark (id) or lie in an excluded category (category); what is in the trash is no article."""
    articles = articles.where("status NOT IN ('trash', 'auto-draft')")
    return articles.join(marks, "id", "left_semi").select("id").unionByName(articles.join(categories, "category", "left_semi").select("id")).distinct()


def eligible(articles: DataFrame, out: DataFrame, types: list[str]) -> DataFrame:
    """Published articles of these types that aren't excluded. articles: id, type, published, category."""
    return articles.where(F.col("published") & F.col("type").isin(types)).join(out, "id", "left_anti")


def requirement(reference: DataFrame, values: list[str]) -> DataFrame:
    """types and, for each of the named columns of values, what an article must have to go with a reference article (a row); no row if there is none: then nothing matches."""
    return reference.select(F.array("type").alias("types"), *[F.col(v).alias(f"need_{v}") for v in values]).limit(1)


def meets(articles: DataFrame, needs: DataFrame, values: list[str]) -> DataFrame:
    """Articles of a required type that share a value with every need that isn't empty (needs: a row of `requirement`, or none)."""
    shared = [(F.size(f"need_{v}") == 0) | F.arrays_overlap(v, f"need_{v}") for v in values]
    condition = F.array_contains("types", F.col("type"))
    for one in shared:
        condition = condition & one
    return articles.join(F.broadcast(needs), condition, "left_semi")  # one row


def after(rows: DataFrame, cursor: int, n: int) -> DataFrame:
    """The page of n ids after a cursor."""
    return rows.where(F.col("id") > cursor).orderBy("id").limit(n)


def visible(rows: DataFrame, user: int, may_edit: list[str], may_read: list[str]) -> DataFrame:
    """Public rows, own ones, others' that aren't private of types one may edit, private ones of types one may read; never trash."""
    kind, status = F.col("type"), F.col("status")
    shown = (status == "public") | (F.col("author") == user) | ((status != "private") & kind.isin(may_edit)) | ((status == "private") & kind.isin(may_read))
    return rows.where((status != "trash") & shown)


def fold(text: Column) -> Column:
    """Lower case, quotes and dashes made plain, white space collapsed, accents gone but for ñ."""
    plain = F.translate(F.lower(text), ACCENTED + "’‘“”–—", FOLDED + "''\"\"--")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def surfaces(articles: DataFrame) -> DataFrame:
    """term, surface: the form a term is most often written in; of equals the smaller."""
    seen = articles.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("n"), "surface"))
    return seen.withColumn("term", F.lower("surface")).withColumn("rn", rank).where("rn = 1").select("term", "surface")


def embedding_text(title: Column, text: Column, words: int = 300, most: int = 2000) -> Column:
    """What stands for an article before an embedder: its title and first words."""
    return F.substring(F.concat_ws("\n", title, F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")), 1, most)


def limited(calls: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """Calls (id, who, at_s) beyond `most` in one fixed window of seconds."""
    w = W.partitionBy("who", F.floor(F.col("at_s") / seconds)).orderBy("at_s", "id")
    return calls.withColumn("i", F.row_number().over(w)).where(F.col("i") > most).select("id")


def preference(candidates: DataFrame) -> DataFrame:
    """source, id, rank: fit ones by confidence (none: 0.5), then unknown, then unfit; ties by id. candidates: source, id, fit, confidence."""
    group = F.when(F.col("fit"), 0).when(F.col("fit").isNull(), 1).otherwise(2)
    order = W.partitionBy("source").orderBy(group, F.desc(F.when(group == 0, F.coalesce("confidence", F.lit(0.5))).otherwise(0.0)), "id")
    return candidates.select("source", "id", F.row_number().over(order).alias("rank"))


def targets_with_anchors(edges: DataFrame) -> DataFrame:
    """source, target, anchors: each pair's distinct anchors in the order of their first place."""
    first = edges.groupBy("source", "target", "anchor").agg(F.min("place").alias("p"))
    return first.groupBy("source", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "anchor"))), lambda x: x.anchor), "|").alias("anchors"))
