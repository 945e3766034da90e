"""Rules that link a phrase to a target: where their phrases stand, which links they would set, and that for saved articles alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import analyzer
from linkloom.functions.automaton import Automaton
from linkloom.functions.text import tokens

from . import positions, suggest

#: Phrases of up to so many go to every task as one automaton; more are joined with the words of texts by their first key.
AUTOMATON_PHRASES = 200_000
#: An anchor that already leads to the target from so many other articles isn't set again; words for each link that an article takes.
REUSED, WORDS_PER_LINK = 5, 100
PLACES = "doc_id long, sentence int, place int, words int, phrase string, anchor string"


def _one_pass(automaton, stemmed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s, (a, b, _) in enumerate(analyzer.sentences(text)):
                    sentence, at = text[a:b], 0
                    if analyzer.masked(sentence) != sentence:
                        continue
                    for words in analyzer.runs(sentence, lang, stemmed):
                        keys = [t.key for t in words]
                        for i, n in automaton.value.matches(keys):
                            rows.append((doc, s, at + i, n, " ".join(keys[i : i + n]), " ".join(t.surface for t in words[i : i + n])))
                        at += len(words)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], [x.split()[0] for x in PLACES.split(", ")])

    return run


def matches(phrases: DataFrame, articles: DataFrame, stemmed: bool = False, most: int = AUTOMATON_PHRASES) -> DataFrame:
    """PLACES: everywhere a phrase (phrase: keys joined by spaces) stands in an article's sentences that hold no address, without a sign within it. anchor: its words as they are.

    Phrases of more than positions.MAX_WORDS words are left out. Up to `most` of them are read into an automaton that goes over
    each text once; beyond that, phrases meet the places of their first key in a join.
    """
    asked = phrases.where(F.size(F.split("phrase", " ")) <= positions.MAX_WORDS).where("phrase <> ''").select("phrase").distinct()
    few = asked.limit(most + 1).toArrow()["phrase"].to_pylist()  # most + 1 rows at most
    if len(few) <= most:
        automaton = articles.sparkSession.sparkContext.broadcast(Automaton(sorted(few)))
        return articles.select("doc_id", "lang", "text").mapInArrow(_one_pass(automaton, stemmed), PLACES)
    keyed = asked.withColumn("keys", F.split("phrase", " ")).withColumn("key", F.get("keys", F.lit(0)))
    held = positions.sentences(articles).where("NOT linked")
    met = positions.positions(held.select("doc_id", "lang", "sentence", "text"), stemmed).join(keyed, "key")
    span = met.withColumn("span", F.slice("ahead", F.lit(1), F.size("keys"))).where(F.transform("span", lambda t: t["k"]) == F.col("keys"))
    return span.select("doc_id", "sentence", "place", F.size("keys").alias("words"), "phrase", F.array_join(F.transform("span", lambda t: t["surface"]), " ").alias("anchor"))


def plan(rules: DataFrame, articles: DataFrame, links: DataFrame, per_rule: int = 1, ignored: list[str] | None = None, sites: DataFrame | None = None, stemmed: bool = False, most: int = AUTOMATON_PHRASES) -> DataFrame:
    """rule, doc_id, sentence, anchor: the links that rules (rule, phrase, target) would set, in text order, the longest first where several begin.

    An article takes max(1, words div WORDS_PER_LINK) links less those that it has (links: doc_id, n), its target's article none,
    a rule per_rule at most, a target one; links don't overlap. Of rules with one phrase the smallest that leads
    elsewhere counts. Anchors that hold an ignored word are left out, as are those that lead to the target from REUSED
    other articles already (sites: phrase, target, n). The order decides, so an article's places are one array that is folded.
    """
    found = matches(rules, articles, stemmed, most)
    met = found.join(rules.select("phrase", "rule", "target"), "phrase").where("doc_id <> target")
    one = met.withColumn("rn", F.row_number().over(W.partitionBy("doc_id", "sentence", "place", "phrase").orderBy("rule"))).where("rn = 1").drop("rn")
    if ignored:
        one = one.where(~suggest.ignored(F.col("anchor"), ignored))
    if sites is not None:
        one = one.join(sites.where(F.col("n") >= REUSED).select("phrase", "target"), ["phrase", "target"], "left_anti")
    each = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence", "place", (-F.col("words")).alias("by"), "rule", "target", "anchor", "words"))).alias("all"))
    room = articles.select("doc_id", F.greatest(F.lit(1), F.floor(F.size(tokens(F.col("text"))) / WORDS_PER_LINK)).alias("cap"))
    own = each.join(room, "doc_id").join(links, "doc_id", "left").withColumn("room", F.col("cap") - F.coalesce("n", F.lit(0)))

    def fold(kept, x):
        last = F.element_at(kept, -1)
        clear = (F.size(kept) == 0) | (last["sentence"] < x["sentence"]) | (last["place"] + last["words"] <= x["place"])
        free = (F.size(F.filter(kept, lambda k: k["rule"] == x["rule"])) < per_rule) & ~F.exists(kept, lambda k: k["target"] == x["target"])
        return F.when((F.size(kept) < F.col("room")) & F.when(F.size(kept) == 0, True).otherwise(clear) & free, F.concat(kept, F.array(x))).otherwise(kept)

    chosen = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), fold)
    return own.select("doc_id", F.explode(chosen).alias("x")).select("x.rule", "doc_id", "x.sentence", "x.anchor")


def apply_saved(rules: DataFrame, articles: DataFrame, saved: DataFrame, links: DataFrame, **limits) -> DataFrame:
    """The plan for saved articles alone (saved: doc_id): the others' texts aren't read beyond their ids."""
    own = articles.join(saved.select("doc_id").distinct(), "doc_id", "left_semi")
    return plan(rules, own, links, **limits)
