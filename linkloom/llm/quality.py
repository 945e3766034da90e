"""Quality rules: text statistics in Spark expressions and a decision list learned from labels.

The list is learned by sequential covering: a rule grows by the threshold condition of the largest
information gain on two thirds of the labelled rows, is pruned on the other third, and takes what it
covers out of both; the list ends with the first rule that isn't precise enough. Its rules become one
ordered Spark conditional expression. No row leaves the JVM but the statistics of the labelled sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SPACE, spread, table, without

#: Labelled rows that a list is learned from at most, the first in the order of their ids' hashes.
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, MAX_CUTS = 12, 3, 48
#: A rule must be right for this share of the rows it covers in the pruning part, and cover so many rows that it is right for.
PRECISION, SUPPORT = 0.95, 3
NGRAM = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_distinct")
RATES = {
    "mean_word": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_words",
    "repeats": "n_repeat_words / n_words",
    "upper": "n_upper / word_chars",
    "bangs": "n_bangs / n_words",
    "distinct": "n_distinct / n_words",
    "words": "cast(n_words AS double)",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the optimizer may put an expression in place of a column's name, in a loop too, but not of a lambda's variable."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column) -> Column:
    """Words in windows of NGRAM words that occur twice or more."""

    def covered(places: Column) -> Column:
        size = F.size(places)
        steps = F.zip_with(F.slice(places, F.lit(1), size - 1), F.slice(places, F.lit(2), size - 1), lambda a, b: F.least(b - a, F.lit(NGRAM)))
        return F.aggregate(steps, F.lit(NGRAM), lambda s, x: s + x)

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, j: (x.h == F.get(pairs, j - 1).h) | (x.h == F.get(pairs, j + 1).h))
        return F.array_sort(F.transform(twice, lambda x: x.i))

    def count(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), _let(pairs, lambda p: _let(places(p), covered))).otherwise(0)

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (NGRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(NGRAM))))
    return F.when(F.size(words) >= NGRAM, _let(grams, count)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with STATS as longs: words, their code points, symbols, repeated lines, words in repeated 5-word windows, capitals, exclamation marks, distinct words.

    A null text counts as an empty one. Input columns named like these are replaced.
    """
    docs = without(docs, *STATS, "__s")
    text = F.coalesce("text", F.lit(""))
    words = _let(
        F.array_remove(F.split(text, SPACE), ""),
        lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct")),
    )
    lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = {"n_symbols": r"[#*$%&|<>]", "n_upper": r"\p{Lu}", "n_bangs": "!"}
    found = {c: F.regexp_count(text, F.lit(x)) for c, x in counted.items()} | {"n_dup_lines": lines}
    seen = docs.select(*[docs[f"`{c}`"] for c in docs.columns], words.alias("__s"), *[x.alias(c) for c, x in found.items()])
    return seen.select(*[docs[f"`{c}`"] for c in docs.columns], *[(F.col(c) if c in found else F.col("__s")[c]).cast("long").alias(c) for c in STATS])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.coalesce(F.expr(f"try_divide({RATES[self.feature].replace(' / ', ', ')})") if " / " in RATES[self.feature] else F.expr(RATES[self.feature]), F.lit(0.0))
        return value > self.cut if self.above else value <= self.cut

    def mask(self, x: np.ndarray) -> np.ndarray:
        own = x[:, list(RATES).index(self.feature)]
        return own > self.cut if self.above else own <= self.cut


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.mask(x) for c in rule]) if rule else np.ones(len(x), bool)


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].sum() and not bad[inside].all():
        best, gain = None, 0.0
        share = math.log2(bad[inside].mean())
        for k, feature in enumerate(RATES):
            for cut in np.unique(np.quantile(x[inside & bad, k], np.linspace(0, 1, MAX_CUTS // 2))).tolist() + np.unique(np.quantile(x[inside, k], np.linspace(0, 1, MAX_CUTS // 2))).tolist():
                for above in (True, False):
                    got = inside & Condition(feature, above, cut).mask(x)
                    right = bad[got].sum()
                    if right >= SUPPORT and (g := right * (math.log2(right / got.sum()) - share)) > gain + 1e-9:
                        best, gain = Condition(feature, above, cut), g
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        got = _covers(r, x)
        right = bad[got].sum()
        return (2 * right - got.sum()) / got.sum() if got.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def _center(rule: list[Condition], x: np.ndarray) -> list[Condition]:
    """Every cut moved to the middle of the gap between what its rule covers and what it alone keeps out."""
    for i, c in enumerate(rule):
        k, others = list(RATES).index(c.feature), _covers(rule[:i] + rule[i + 1 :], x)
        inside, outside = x[others & c.mask(x), k], x[others & ~c.mask(x), k]
        if len(inside) and len(outside):
            ends = (inside.min(), outside.max()) if c.above else (inside.max(), outside.min())
            rule = [*rule[:i], Condition(c.feature, c.above, float(sum(ends)) / 2), *rule[i + 1 :]]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, prune: np.ndarray) -> list[list[Condition]]:
    """Rules for bad rows, in the order they were found. x: rows x RATES; prune: the rows kept for pruning."""
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and bad[left & ~prune].any():
        rule = _grow(x[left & ~prune], bad[left & ~prune])
        if not rule:
            break
        rule = _prune(rule, x[left & prune], bad[left & prune])
        got = left & _covers(rule, x)
        for part in (got & prune, got):
            if part.any() and bad[part].mean() < PRECISION:
                return rules
        if bad[got].sum() < SUPPORT:
            break
        rules.append(_center(rule, x[left]))
        left &= ~got
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """A decision list from documents' statistics and labels (doc_id, quality 0 or 1), from `rows` labelled rows at most.

    Labels that are null, or differ for one doc_id, teach nothing; without labels the list is empty. Of documents that
    share a doc_id the one with the smallest text teaches. Which rows teach doesn't depend on their order.
    """
    sure = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where("quality = q")
    sample = sure.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # rows of the sample, a documented bound
    seen = statistics(one)
    rates = [F.coalesce(F.expr(f"try_divide({v.replace(' / ', ', ')})") if " / " in v else F.expr(v), F.lit(0.0)).alias(k) for k, v in RATES.items()]
    got = sorted(tuple(r) for r in seen.select("doc_id", "quality", *rates).collect())
    if not got:
        return []
    prune = np.array([zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in got])
    return learn(np.array([r[2:] for r in got], float), np.array([r[1] == 0 for r in got]), prune)


def verdict(rules: list[list[Condition]]) -> Column:
    """The first rule that holds, from 1, as one ordered conditional expression; null where none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, i).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs with STATS, base_failed, rule (the first that holds) and kept.

    base_failed: under ten words, or over a fifth of the words in windows found twice; a null or
    empty text fails. kept: neither that nor any rule. Repeated rows get equal answers.
    """
    docs = without(docs, "base_failed", "rule", "kept")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs.select("doc_id", "text"), rules).select("doc_id", *STATS[:5], "base_failed", "kept", "rule")
