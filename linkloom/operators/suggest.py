"""Link suggestions: languages of texts, phrases, anchors, scores, and the choice among them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.lexicon import MARKERS
from linkloom.functions.text import MASK, tokens

from . import positions

#: What the parts of a score weigh, what is taken off, and what a suggestion must reach.
RELEVANCE, ANCHOR, ORPHAN, POSITION, FRESH = 0.55, 0.25, 0.05, 0.10, 0.05
DENSE, REUSED, UNLIKE, PENALTY = 0.2, 0.1, 0.3, 0.1
MIN_SCORE, MIN_RELEVANCE = 0.35, 0.15
#: Fixed value: short words that lean on the next, as in French.
ELISION = r"(^|[^\p{L}])(?:qu|[cdjlmnst])['’]"
ANCHOR_QUALITY = {"title": 1.0, "focus": 1.0, "ngram": 0.7, "unigram": 0.4}


def markers(spark) -> DataFrame:
    """word, lang, ord, share: a word of several languages counts for each in part. A fixed list of some two hundred rows."""
    owners: dict[str, list[str]] = {}
    for lang, words in MARKERS.items():
        for w in words.split():
            owners.setdefault(w, []).append(lang)
    return spark.createDataFrame([(w, x, list(MARKERS).index(x), 60 // len(own)) for w, own in owners.items() for x in own], "word string, lang string, ord int, share int")


def detect(texts: DataFrame, min_words: int = 30) -> DataFrame:
    """doc_id, detected: the language of the first 6000 characters' first 400 words, null where it isn't clear.

    Clear: marker words make up 12 % of the words, and the first language has 1.6 times the second's.
    """
    bare = F.regexp_replace(F.lower(F.substring("text", 1, 6000)), ELISION, "$1")
    words = F.slice(F.regexp_extract_all(bare, F.lit(r"\p{L}+"), F.lit(0)), 1, 400)
    counted = texts.select("doc_id", words.alias("w")).withColumn("n", F.size("w"))
    hits = counted.where(F.col("n") >= min_words).select("doc_id", "n", F.explode("w").alias("word")).join(F.broadcast(markers(texts.sparkSession)), "word")
    sums = hits.groupBy("doc_id", "n", "lang", "ord").agg(F.sum("share").alias("s"))
    w = W.partitionBy("doc_id").orderBy(F.desc("s"), "ord")
    best = sums.withColumn("second", F.lead("s", 1, 0).over(w)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    clear = best.where("100 * s >= 12 * 60 * n AND 10 * s >= 16 * second").select("doc_id", F.col("lang").alias("detected"))
    return texts.select("doc_id").join(clear, "doc_id", "left")


def dominant_foreign(texts: DataFrame) -> DataFrame:
    """doc_id, foreign: the other language with the most marker words, twice at least and over twice the own ones'."""
    hits = texts.select("doc_id", F.col("lang").alias("own"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).join(F.broadcast(markers(texts.sparkSession)), "word")
    n = hits.groupBy("doc_id", "own", "lang", "ord").agg(F.count("*").alias("n"))
    home = n.where("lang = own").select("doc_id", F.col("n").alias("home"))
    foreign = n.where("lang <> own").withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "ord"))).where("rn = 1")
    return foreign.join(home, "doc_id", "left").where("n >= 2 AND n > 2 * coalesce(home, 0)").select("doc_id", F.col("lang").alias("foreign"))


def anchor_quality(kind: Column, words: Column) -> Column:
    base = F.coalesce(*[F.when(kind == k, v) for k, v in ANCHOR_QUALITY.items()], F.lit(0.0))
    return F.least(base + F.when(words >= 2, 0.1).otherwise(0.0), F.lit(1.0))


def score(c: dict[str, Column]) -> Column:
    """c: relevance, kind, anchor_words, inbound, position (0 to 1), last, age_days (null: not known, so not fresh), source_links, source_words, anchor_uses, unlike, penalized."""
    place = F.when(c["last"], 0.4).when(c["position"] <= 0.6, 1.0).otherwise(0.6)
    fresh = F.when(c["age_days"] <= 365, 1.0).otherwise(0.0)
    plus = RELEVANCE * c["relevance"] + ANCHOR * anchor_quality(c["kind"], c["anchor_words"]) + ORPHAN / (1 + c["inbound"]) + POSITION * place + FRESH * fresh
    dense = (c["source_words"] > 0) & (100 * c["source_links"] > c["source_words"])
    minus = DENSE * F.when(dense, 1.0).otherwise(0.0) + REUSED * F.when(c["anchor_uses"] > 5, 1.0).otherwise(0.0) + UNLIKE * c["unlike"].cast("double") + PENALTY * c["penalized"].cast("double")
    return plus - minus


def passes(value: Column, relevance: Column) -> Column:
    """Decided before any bonus: bonuses reorder, they never admit."""
    return (value >= MIN_SCORE) & (relevance >= MIN_RELEVANCE)


def bonus(pillar: Column, affinity: Column) -> Column:
    """What a pillar page and shared categories (their number) add."""
    return F.when(pillar, 0.05).otherwise(0.0) + F.least(F.lit(0.10), 0.05 * affinity)


def facts(articles: DataFrame) -> DataFrame:
    """doc_id, source, words, links (addresses in the text), title_words, same_title (documents of this title)."""
    title = F.lower("title")
    own = articles.select("doc_id", "source", F.size(tokens(F.col("text"))).alias("words"), F.regexp_count("text", F.lit(MASK)).alias("links"), F.size(tokens(F.col("title"))).alias("title_words"), F.xxhash64(title).alias("t"))
    return own.join(own.groupBy("t").agg(F.count("*").alias("same_title")), "t").drop("t")


def with_signals(pairs: DataFrame, inbound: DataFrame, ages: DataFrame, dismissed: DataFrame, penalized: DataFrame, pillars: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) that weren't dismissed, with what is known of their target: inbound, age_days, penalized, pillar.

    inbound: id, inbound (none known: 0); ages: id, age_days (not known: null, so not fresh); dismissed: source, target; penalized:
    target; pillars: id. Each may name an article once only, but for dismissed, where rows may repeat. All are joined by the target
    or the pair, never sent whole to a task.
    """
    left = pairs.join(dismissed.select(F.col("source").alias("src"), F.col("target").alias("dst")), ["src", "dst"], "left_anti")
    known = left.join(inbound.select(F.col("id").alias("dst"), "inbound"), "dst", "left").join(ages.select(F.col("id").alias("dst"), "age_days"), "dst", "left")
    low = penalized.select(F.col("target").alias("dst"), F.lit(True).alias("penalized"))
    high = pillars.select(F.col("id").alias("dst"), F.lit(True).alias("pillar"))
    known = known.join(low, "dst", "left").join(high, "dst", "left")
    return known.withColumns({"inbound": F.coalesce("inbound", F.lit(0)), "penalized": F.coalesce("penalized", F.lit(False)), "pillar": F.coalesce("pillar", F.lit(False))})


def anchors(candidates: DataFrame, articles: DataFrame, stored: DataFrame, used: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """src, dst, sentence, start (place of the anchor's first word), anchor, phrase (the keys of its words), words, kind, position, last: where a candidate's source (src, dst) holds a phrase of its target, as an anchor may be.

    A source meets the phrases of its own candidates, see positions.search. position: of the sentence, from 0 to 1; last: in the last paragraph.
    """
    phrases = positions.target_phrases(articles, stored, stemmed=stemmed)
    found = positions.search(articles, candidates, phrases, positions.expansions(articles, stored), used, stemmed)
    return found.select("src", "dst", "sentence", F.col("place").alias("start"), "anchor", F.col("key").alias("phrase"), "words", "kind", (F.col("sentence") / F.col("n_sentences")).alias("position"), "last")


def best_anchor(scored: DataFrame) -> DataFrame:
    """The best match of each (src, dst): score, then the earlier place, the longer phrase, the smaller one."""
    w = W.partitionBy("src", "dst").orderBy(F.desc("score"), "sentence", "start", F.desc("words"), "phrase")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def choose(suggestions: DataFrame, most: int = 10) -> DataFrame:
    """Per source in the order of (score desc, dst): one suggestion a sentence and one a phrase, `most` at most.

    Order decides, so each source's suggestions, 200 candidates at most, are one array that is folded in this order.
    """
    cols = suggestions.select("src", F.struct((-F.col("score")).alias("by"), "dst", "sentence", "anchor", "phrase", "score").alias("x"))
    taken = lambda kept, x: F.exists(kept, lambda k: (k["sentence"] == x["sentence"]) | (k["phrase"] == x["phrase"]))
    fold = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), lambda kept, x: F.when((F.size(kept) < most) & ~taken(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    rows = cols.groupBy("src").agg(F.sort_array(F.collect_list("x")).alias("all")).select("src", F.posexplode(fold).alias("at", "x"))
    return rows.select("src", "x.dst", "x.sentence", "x.anchor", "x.phrase", "x.score", (F.col("at") + 1).alias("rank"))


def alternatives(scored: DataFrame, chosen: DataFrame, margin: int = 100_000, most: int = 3) -> DataFrame:
    """src, dst, alternative (from 1), anchor, phrase: of each chosen suggestion the next best matches in other sentences.

    Within margin (millionths) of its score, one a sentence, `most` at most; none that another suggestion of the source has as its anchor.
    """
    shown = chosen.select("src", "dst", F.col("sentence").alias("own"), F.col("phrase").alias("main"), F.col("score").alias("top"))
    near = scored.join(shown, ["src", "dst"]).where(F.col("sentence") != F.col("own")).where(F.col("score") >= F.col("top") - margin)
    taken = chosen.select("src", F.col("dst").alias("other"), "phrase")
    free = near.join(taken, (near.src == taken.src) & (near.phrase == taken.phrase) & (near.dst != taken.other), "left_anti")
    w = W.partitionBy("src", "dst", "sentence").orderBy(F.desc("score"), "start", F.desc("words"), "phrase")
    one = free.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    rank = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("score"), "sentence"))
    return one.withColumn("alternative", rank).where(F.col("alternative") <= most).select("src", "dst", "alternative", "anchor", "phrase")


def without_ignored(suggestions: DataFrame, words: list[str], targets: DataFrame) -> DataFrame:
    """Suggestions whose anchor holds none of the words, whole and in any case, and whose target (id) isn't ignored."""
    left = suggestions.join(targets.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left.where(~ignored(F.col("anchor"), words)) if words else left


def ignored(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, whole and in any case."""
    return text.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}])")


def reasons(pairs: DataFrame, weights: DataFrame, stored: DataFrame, most: int = 3) -> DataFrame:
    """src, dst, term, reason (from 1): the shared terms with the greatest products of weights."""
    a = weights.select(F.col("doc_id").alias("src"), "lang", "term", F.col("weight").alias("w"))
    b = stored.select(F.col("doc_id").alias("dst"), "lang", "term", "weight")
    shared = pairs.select("src", "dst").join(a, "src").join(b, ["dst", "lang", "term"])
    rank = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc(F.col("w") * F.col("weight")), "term"))
    return shared.withColumn("reason", rank).where(F.col("reason") <= most).select("src", "dst", "term", "reason")


def rule_candidates(rules: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, rule, phrase, target: documents that hold the first key of a rule's phrase (terms: doc_id, term of the index)."""
    first = rules.withColumn("first", F.substring_index("phrase", " ", 1))
    return first.join(terms.select("doc_id", F.col("term").alias("first")), "first").where("doc_id <> target").select("doc_id", "rule", "phrase", "target")


def why_not(article: dict[str, Column], rule: dict[str, Column]) -> Column:
    """The first reason why a rule doesn't apply to an article, null if it does. article: published, ignored, excluded, type, category, lang; rule: types, categories, langs (empty: all)."""
    other = lambda of, one: (F.size(of) > 0) & ~F.array_contains(of, one)
    return (
        F.when(~article["published"], "not published").when(article["ignored"], "ignored").when(article["excluded"], "excluded")
        .when(other(rule["types"], article["type"]), "type").when(other(rule["categories"], article["category"]), "category").when(other(rule["langs"], article["lang"]), "language")
    )
