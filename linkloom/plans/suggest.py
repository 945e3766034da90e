"""Queries over suggestions, rules and streams, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.lexicon import MARKERS
from linkloom.functions.stemming import stem_english
from linkloom.functions.text import MASK, WORD, micro
from linkloom.operators import graph as graph_ops
from linkloom.operators import history, index, positions, retrieval, rules, suggest, terms, words
from linkloom.sources.scratch import keep
from linkloom.sources.tables import articles, changes, edges, read
from linkloom.streaming import incremental, stateful

from . import graph, text
from . import index as index_plans
from . import store as store_plans
from . import words as word_plans


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return suggest.detect(articles(spark, d))


def dominant_foreign(spark: SparkSession, d: str) -> DataFrame:
    return suggest.dominant_foreign(articles(spark, d))


#: Documents retrieved for a source, before anchors and scores choose among them, and origins for a target.
CANDIDATES, ORIGINS = 200, 100
#: The query set of searches by the contract; what is searched is every article.
SOURCES = "doc_id % 20 = 0"


def _signals(own: DataFrame) -> dict:
    """The parts of a score. No link, date or dismissal is known of documents, so these take their defaults."""
    c = F.col
    return {
        "relevance": c("relevance"), "kind": c("kind"), "anchor_words": c("words"), "inbound": F.lit(0), "position": c("position"), "last": c("last"), "age_days": F.lit(None).cast("int"),
        "source_links": c("source_links"), "source_words": c("source_words"), "anchor_uses": c("anchor_uses"), "unlike": F.lit(False), "penalized": F.lit(False),
    }


def _relevant(near: DataFrame, group: str = "src") -> DataFrame:
    """src, dst, relevance: by the group's greatest similarity; 0 where nothing in the group is similar."""
    most = F.max("score").over(W.partitionBy(group))
    return near.select("src", "dst", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias("relevance"))


def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the candidates as if linked by their titles at the end of the text's first half; a title that others have too is used so often."""
    own = articles(spark, d)
    near = _relevant(index_plans.index_similar(spark, d))
    facts = suggest.facts(own)
    src = facts.select(F.col("doc_id").alias("src"), F.col("words").alias("source_words"), F.col("links").alias("source_links"))
    dst = facts.select(F.col("doc_id").alias("dst"), F.col("title_words").alias("words"), F.col("same_title").alias("anchor_uses"))
    known = near.join(src, "src").join(dst, "dst").withColumns({"kind": F.when(F.col("words") > 1, "title").otherwise("unigram"), "position": F.lit(0.5), "last": F.lit(False)})
    value = known.withColumn("score", micro(suggest.score(_signals(known))))
    return value.select("src", "dst", "score", suggest.passes(F.col("score") / 1e6, F.col("relevance")).alias("passes"))


def score_signals(spark: SparkSession, d: str) -> DataFrame:
    """The same candidates by what links, log and dismissals say of their targets: an article's links are those of the part, its changes those of the user of its id.

    Returned links are dismissals: such a pair is no candidate, and targets dismissed from more than ten sources are penalised.
    Whether a candidate passes is decided before the bonus of pillars and of a source in common.
    """
    own = articles(spark, d)
    links = edges(spark, d)
    ids = own.select(F.col("doc_id").alias("id"))
    gone = links.where("broken").select("source", "target")
    near = suggest.with_signals(_relevant(index_plans.index_similar(spark, d)), graph_ops.inbound(links, ids), history.ages(changes(spark, d)), gone, graph_ops.penalized(gone), store_plans.pillars(spark, d))
    facts = suggest.facts(own)
    src = facts.select(F.col("doc_id").alias("src"), F.col("words").alias("source_words"), F.col("links").alias("source_links"), F.col("source").alias("a"))
    dst = facts.select(F.col("doc_id").alias("dst"), F.col("title_words").alias("words"), F.col("same_title").alias("anchor_uses"), F.col("source").alias("b"))
    known = near.join(src, "src").join(dst, "dst").withColumns({"kind": F.when(F.col("words") > 1, "title").otherwise("unigram"), "position": F.lit(0.5), "last": F.lit(False)})
    value = known.withColumn("score", micro(suggest.score(_signals(known) | {c: F.col(c) for c in ("inbound", "age_days", "penalized")})))
    plus = suggest.bonus(F.col("pillar"), F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0)))
    return value.select("src", "dst", "inbound", "age_days", "penalized", "score", suggest.passes(F.col("score") / 1e6, F.col("relevance")).alias("passes"), (F.col("score") + micro(plus)).alias("ordered_by"))


def _scored(spark: SparkSession, d: str, pairs: DataFrame, stored: DataFrame, sources: str = "true") -> DataFrame:
    """Matches of the pairs that pass, with their scores; sources: which articles may be a source, as only their words are counted; shared sources of the documents are an affinity that reorders."""
    own = articles(spark, d)
    found = keep(suggest.anchors(pairs, own, stored)).join(pairs, ["src", "dst"])
    said = suggest.facts(own.where(sources))
    src = said.select(F.col("doc_id").alias("src"), F.col("words").alias("source_words"), F.col("links").alias("source_links"), F.col("source").alias("a"))
    dst = suggest.facts(own).select(F.col("doc_id").alias("dst"), F.col("same_title").alias("anchor_uses"), F.col("source").alias("b"))
    known = found.join(src, "src").join(dst, "dst")
    value = known.withColumn("value", suggest.score(_signals(known))).where(suggest.passes(F.col("value"), F.col("relevance")))
    return value.withColumn("score", (F.round(F.col("value") + suggest.bonus(F.lit(False), F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0))), 4) * 1e6).cast("long"))


def _outgoing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    weighted, stored = index.build(articles(spark, d))
    pairs = keep(_relevant(retrieval.similar(weighted.where(SOURCES), stored, CANDIDATES)))
    return pairs, stored


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scored = keep(_scored(spark, d, *_outgoing(spark, d), SOURCES))
    return scored, suggest.choose(suggest.best_anchor(scored))


def anchor_matches(spark: SparkSession, d: str) -> DataFrame:
    """Where articles whose id is divisible by 20 hold phrases of their candidates, which are of all articles."""
    pairs, stored = _outgoing(spark, d)
    own = articles(spark, d)
    return suggest.anchors(pairs, own, stored).select("src", "dst", "sentence", "start", "anchor", "kind")


def outgoing_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Up to ten suggestions for every article whose id is divisible by 20, among all articles."""
    return _chosen(spark, d)[1].drop("phrase")


def suggestion_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Other anchors for `outgoing_suggestions`, in other sentences."""
    scored, chosen = _chosen(spark, d)
    return suggest.alternatives(scored, keep(chosen)).drop("phrase")


def suggestion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The three shared terms that weigh most, for the ten nearest of every article whose id is divisible by 20."""
    weighted, stored = index.build(articles(spark, d), stemmed=False)
    return suggest.reasons(retrieval.similar(weighted.where(SOURCES), stored, 10), weighted, stored)


def incoming_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Every passing origin of the targets whose id is divisible by 20, of ORIGINS candidates: those that hold a phrase of the target's first, filled up with similar ones."""
    own = articles(spark, d)
    weighted, stored = index.build(own)
    asked = stored.where(SOURCES)
    wanted = positions.target_phrases(own, stored, stemmed=True).where("words <= 3").where("target % 20 = 0").select("target", "lang", F.col("phrase").alias("term"))
    named = wanted.select(F.col("target").alias("doc_id"), "lang", "term", F.lit(1).alias("weight"))
    holds = keep(retrieval.similar(keep(named), stored, ORIGINS).select(F.col("src").alias("target"), F.col("dst").alias("origin"), "score"))
    like = retrieval.similar(asked, stored, ORIGINS).select(F.col("src").alias("target"), F.col("dst").alias("origin"), "score")
    pairs = retrieval.fill_up(holds, like, ORIGINS).select(F.col("origin").alias("src"), F.col("target").alias("dst"))
    a, b = stored.select(F.col("doc_id").alias("src"), "term", F.col("weight").alias("w")), asked.select(F.col("doc_id").alias("dst"), "term", "weight")
    near = pairs.join(b, "dst").join(a, ["src", "term"], "left").groupBy("src", "dst").agg(F.coalesce(F.sum(F.col("w") * F.col("weight")), F.lit(0)).alias("score"))
    best = suggest.best_anchor(_scored(spark, d, keep(_relevant(near, "dst")), stored))
    return best.select(F.col("dst").alias("target"), "src", "anchor", "score", F.row_number().over(W.partitionBy("dst").orderBy(F.desc("score"), "src")).alias("rank"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Two words of benchmark items as rules, from the first on that is no stop word."""
    w = F.regexp_extract_all(words.folded(F.col("text")), F.lit(WORD), F.lit(0))
    items = read(spark, d, "benchmark").select("item_id", w.alias("w")).withColumn("at", F.array_position(F.transform("w", lambda x: ~F.array_contains(words.stops(F.lit("en")), x)), True)).where("at > 0")
    return items.select(F.col("item_id").alias("rule"), F.array_join(F.slice("w", F.col("at").cast("int"), F.lit(2)), " ").alias("phrase"), F.col("item_id").alias("target"))


def _text_links(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_count("text", F.lit(MASK)).alias("n"))


def rule_plan(spark: SparkSession, d: str) -> DataFrame:
    """The rules over all documents; the links that a document has are the addresses in its text."""
    docs = articles(spark, d)
    return rules.plan(_rules(spark, d), docs, _text_links(docs), ignored=["the", "les"])


def rule_application(spark: SparkSession, d: str) -> DataFrame:
    """The same for saved articles, those with a label."""
    docs = articles(spark, d)
    return rules.apply_saved(_rules(spark, d), docs, read(spark, d, "labels"), _text_links(docs), ignored=["the", "les"])


def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    """Where the rules' phrases stand."""
    return rules.matches(_rules(spark, d), articles(spark, d)).select("doc_id", "sentence", "place", "phrase")


def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the distinct English words, each stemmed once."""
    words = terms.term_frequency(articles(spark, d).where("lang = 'en'")).select("term").distinct()
    return words.select("term", stem_english("term").alias("stem"))


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events through a stream: counts a day and type; the complete output of the last micro-batch."""
    static = read(spark, d, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    counted = incremental.windowed_counts(stream).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return incremental.run_once(counted, "complete", counted, incremental.folder(spark))


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    return spark.readStream.schema(read(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), F.col("ts").alias("at"))


def stream_rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Events through a stream: those beyond two in ten minutes of a user's first; windows are state that timers end."""
    return stateful.run(stateful.rate_limited(_calls(spark, d), 600, 2), incremental.folder(spark))


def stream_day_limited(spark: SparkSession, d: str) -> DataFrame:
    """The same with one event in 24 hours of a user's first: most windows hold several."""
    return stateful.run(stateful.rate_limited(_calls(spark, d), 86_400, 1), incremental.folder(spark))


def stream_retained(spark: SparkSession, d: str) -> DataFrame:
    """Changes left when the days that ended 14 days before the newest change, by timers of a stream, are gone."""
    log = _streamed(spark, d, "events").select(F.to_date("ts").alias("batch"), F.col("ts").alias("at"))
    ended = stateful.run(stateful.expired_groups(log, 14), incremental.folder(spark)).select(F.col("batch").cast("date").alias("batch"))
    return changes(spark, d).join(ended, "batch", "left_anti").select("id")


def stream_notices(spark: SparkSession, d: str) -> DataFrame:
    """Events as notices, an hour is a request: each article once for each request."""
    at = F.col("ts").cast("timestamp")
    notices = _streamed(spark, d, "events").select(F.unix_seconds(F.date_trunc("hour", at)).alias("request"), F.col("user_id").alias("article"), at.alias("at"))
    return stateful.run(stateful.notices_once(notices), incremental.folder(spark))


def stream_lost_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a stream of saves, against the links logged for the page before."""
    saved = _streamed(spark, d, "pages").select(F.col("page_id").alias("article"), "html")
    return stateful.stream_lost_links(saved, word_plans.link_log(spark, d), incremental.folder(spark))


def stream_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    static = read(spark, d, "documents")
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/documents.parque[t]").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return incremental.stream_frequencies(stream, incremental.folder(spark)).where(F.col("df") >= terms.MIN_DF)


_M = ", ".join(f"('{w}', '{lang}', {o})" for o, (lang, ws) in enumerate(MARKERS.items()) for w in ws.split())
_MARK = f"m0(word, lang, ord) AS (VALUES {_M}), m AS (SELECT DISTINCT word, lang, ord, 60 // count(*) OVER (PARTITION BY word) AS share FROM (SELECT DISTINCT * FROM m0))"


def _limit(seconds: int, most: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS who, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
      b AS (SELECT who, min(t) AS s FROM e GROUP BY who UNION ALL SELECT b.who, (SELECT min(t) FROM e WHERE e.who = b.who AND e.t >= b.s + {seconds}) FROM b WHERE b.s IS NOT NULL),
      w AS (SELECT e.*, (SELECT max(s) FROM b WHERE b.who = e.who AND b.s <= e.t) AS s FROM e) SELECT id FROM w QUALIFY row_number() OVER (PARTITION BY who, s ORDER BY t, id) > {most}"""


QUERIES = {f.__name__: f for f in (language_detect, dominant_foreign, score_candidates, score_signals, anchor_matches, outgoing_suggestions, incoming_suggestions, suggestion_alternatives, suggestion_reasons, rule_plan, rule_application, rule_matches, stem_vocabulary, stream_event_counts, stream_rate_limited, stream_day_limited, stream_retained, stream_notices, stream_lost_links, stream_document_frequency)}
SQL = {
    "language_detect": rf"""WITH {_MARK}, w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(substring(text, 1, 6000)), '{suggest.ELISION.replace(chr(39), chr(39) * 2)}', '\1', 'g'), '\p{{L}}+')[1:400] AS w FROM documents),
      x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM w WHERE len(w) >= 30), s AS (SELECT doc_id, n, lang, ord, sum(share) AS s FROM x JOIN m USING (word) GROUP BY ALL),
      b AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s DESC, ord), 0) AS second, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS rn FROM s)
      SELECT doc_id, b.lang AS detected FROM documents LEFT JOIN (SELECT doc_id, lang FROM b WHERE rn = 1 AND 100 * s >= 720 * n AND 10 * s >= 16 * second) b USING (doc_id)""",
    "dominant_foreign": rf"""WITH {_MARK}, x AS (SELECT doc_id, lang AS own, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents),
      n AS (SELECT doc_id, own, lang, ord, count(*) AS n FROM x JOIN m USING (word) GROUP BY ALL), h AS (SELECT doc_id, n AS home FROM n WHERE lang = own),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS rn FROM n WHERE lang <> own)
      SELECT doc_id, lang AS foreign FROM f LEFT JOIN h USING (doc_id) WHERE rn = 1 AND n >= 2 AND n > 2 * coalesce(home, 0)""",
    "score_candidates": rf"""{index_plans.SQL["index_similar"].replace("SELECT src, dst, CAST(row_number()", ", n AS (SELECT src, dst, CAST(row_number()")}),
      r AS (SELECT src, dst, score / CAST(max(score) OVER (PARTITION BY src) AS DOUBLE) AS rel FROM n),
      fa AS (SELECT doc_id, len(regexp_extract_all(lower(text), {index_plans._TOK})) AS words, len(regexp_extract_all(text, {index_plans._MASK})) AS links, len(regexp_extract_all(lower(string_split(text, chr(10))[1]), {index_plans._TOK})) AS tw,
        count(*) OVER (PARTITION BY lower(string_split(text, chr(10))[1])) AS same FROM documents),
      v AS (SELECT src, dst, rel, 0.55::DOUBLE * rel + 0.25::DOUBLE * least(CASE WHEN b.tw > 1 THEN 1.0::DOUBLE ELSE 0.4 END + CASE WHEN b.tw >= 2 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) + 0.05::DOUBLE + 0.1::DOUBLE
        - (0.2::DOUBLE * CASE WHEN a.words > 0 AND 100 * a.links > a.words THEN 1 ELSE 0 END + 0.1::DOUBLE * CASE WHEN b.same > 5 THEN 1 ELSE 0 END) AS x FROM r JOIN fa a ON a.doc_id = src JOIN fa b ON b.doc_id = dst)
      SELECT src, dst, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS score, floor(x * 1e6 + 0.5) / 1e6 >= 0.35 AND rel >= 0.15 AS passes FROM v""",
    "score_signals": f"""{index_plans.SQL["index_similar"].replace("SELECT src, dst, CAST(row_number()", ", n AS (SELECT src, dst, CAST(row_number()")}),
      lk AS (SELECT l_orderkey AS source, l_partkey AS target, l_returnflag = 'R' AS broken FROM lineitem), ib AS (SELECT target AS dst, count(DISTINCT source) AS inbound FROM lk WHERE NOT broken AND source <> target GROUP BY 1),
      ag AS (SELECT user_id AS dst, CAST((CAST(floor(epoch((SELECT max(ts) FROM events))) AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT)) // 86400 AS INTEGER) AS age_days FROM events GROUP BY 1),
      pe AS (SELECT target AS dst FROM lk WHERE broken GROUP BY 1 HAVING count(DISTINCT source) > 10), pi AS (SELECT p_partkey AS dst FROM part WHERE p_size = 1 OR p_brand = 'Brand#11'),
      r AS (SELECT src, dst, score / CAST(max(score) OVER (PARTITION BY src) AS DOUBLE) AS rel FROM n),
      fa AS (SELECT doc_id, source, len(regexp_extract_all(lower(text), {index_plans._TOK})) AS words, len(regexp_extract_all(text, {index_plans._MASK})) AS links, len(regexp_extract_all(lower(string_split(text, chr(10))[1]), {index_plans._TOK})) AS tw,
        count(*) OVER (PARTITION BY lower(string_split(text, chr(10))[1])) AS same FROM documents),
      v AS (SELECT src, dst, rel, coalesce(inbound, 0) AS inbound, age_days, pe.dst IS NOT NULL AS penalized, CASE WHEN pi.dst IS NULL THEN 0 ELSE 50000 END + CASE WHEN a.source = b.source THEN 50000 ELSE 0 END AS bonus,
        0.55::DOUBLE * rel + 0.25::DOUBLE * least(CASE WHEN b.tw > 1 THEN 1.0::DOUBLE ELSE 0.4 END + CASE WHEN b.tw >= 2 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) + 0.05::DOUBLE / (1 + coalesce(inbound, 0)) + 0.1::DOUBLE + 0.05::DOUBLE * CASE WHEN age_days <= 365 THEN 1 ELSE 0 END
        - (0.2::DOUBLE * CASE WHEN a.words > 0 AND 100 * a.links > a.words THEN 1 ELSE 0 END + 0.1::DOUBLE * CASE WHEN b.same > 5 THEN 1 ELSE 0 END + 0.1::DOUBLE * CASE WHEN pe.dst IS NULL THEN 0 ELSE 1 END) AS x
        FROM r JOIN fa a ON a.doc_id = src JOIN fa b ON b.doc_id = r.dst LEFT JOIN ib USING (dst) LEFT JOIN ag USING (dst) LEFT JOIN pe ON pe.dst = r.dst LEFT JOIN pi ON pi.dst = r.dst
        WHERE NOT EXISTS (SELECT 1 FROM lk WHERE broken AND lk.source = r.src AND lk.target = r.dst))
      SELECT src, dst, inbound, age_days, penalized, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS score, floor(x * 1e6 + 0.5) / 1e6 >= 0.35 AND rel >= 0.15 AS passes, CAST(floor(x * 1e6 + 0.5) AS BIGINT) + bonus AS ordered_by FROM v""",
    "suggestion_reasons": f"""{index_plans.SQL["index_similar"].split("SELECT src, dst, CAST(row_number()")[0]}, n AS (SELECT src, dst FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 10)
      SELECT src, dst, a.term, CAST(row_number() OVER (PARTITION BY src, dst ORDER BY a.weight * b.weight DESC, a.term) AS INTEGER) AS reason
      FROM n JOIN wt a ON a.doc_id = src JOIN tops b ON b.doc_id = dst AND b.term = a.term AND b.lang = a.lang QUALIFY reason <= 3""",
    "stream_rate_limited": _limit(600, 2),
    "stream_day_limited": _limit(86_400, 1),
    "stream_retained": graph.SQL["retained_changes"],
    "stream_notices": "SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS request, user_id AS article FROM events",
    "stream_lost_links": word_plans.SQL["lost_links"],
    "stream_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_document_frequency": text.SQL["document_frequency"],
}
