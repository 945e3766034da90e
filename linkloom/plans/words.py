"""Queries over words and small texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.lexicon import EN_VERB, ES_VERB, MEASURES, NON_CONTENT, STOP
from linkloom.functions.text import ACCENTED, FOLDED, WORD, micro
from linkloom.operators import index, retrieval, suggest, words
from linkloom.sources.tables import articles, edges, read
from linkloom.streaming import incremental

from .index import _STOPS, _TOK, _WGT, _list
from .index import SQL as _INDEX_SQL

_IGNORED = ["nicht", "con", "would"]


def content_words(spark: SparkSession, d: str) -> DataFrame:
    return words.word_kinds(articles(spark, d))


def verb_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that look like verbs' forms, by document."""
    w = articles(spark, d).select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    return w.groupBy("doc_id").agg(F.count_if(words.verb_like(F.col("word"), F.col("lang"))).alias("verbs"))


def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose fingerprint isn't the stored one: every sixth was stored with another text, every tenth not at all."""
    new = articles(spark, d).select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    stored = new.where("id % 10 > 0").select("id", F.when(F.col("id") % 6 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"))
    return incremental.unchanged(new, stored).select("id")


def model_names(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names as those of models, with providers and dates."""
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", words.model_name(F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit(" Vendor/")).otherwise(F.lit("")), F.regexp_replace("s_name", "[#]", "-"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("-20240131")).when(F.col("s_suppkey") % 3 == 1, F.lit("@latest")).otherwise(F.lit("")))).alias("name"))


def ignored_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles that hold one of some words, whole and in any case."""
    return articles(spark, d).where(suggest.ignored(F.col("title"), _IGNORED)).select("doc_id")


def non_content_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address is one of a legal note, a cart or the like; every seventh page is read as if its last part were `privacy`."""
    p = read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https://x.example/"), F.lit("Privacy/"))).otherwise(F.col("url")).alias("url"))
    return p.where(words.non_content(F.col("url"))).select("page_id")


def generic_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of pages' links that say nothing about their target, these and the shortest words."""
    found = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<a\b[^>]*>([^<]*)</a>"), F.lit(1))).alias("place", "anchor"))
    return found.where(words.generic(F.col("anchor"), ("here", "more", "ver", "de", "the", "la", "der"))).select("page_id", "place", "anchor")


def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", words.normalized(F.concat(F.lit("“"), "title", F.lit("” –  x"))).alias("title"))


def composed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a combining accent put behind every e, composed again."""
    return articles(spark, d).select("doc_id", words.nfc(F.replace("title", F.lit("e"), F.lit("é"))).alias("title"))


def trimmed_titles(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", words.trimmed(F.col("title"), F.col("lang")).alias("term"))


def language_chain(spark: SparkSession, d: str) -> DataFrame:
    override = F.when(F.col("doc_id") % 11 == 0, "FR_fr").when(F.col("doc_id") % 13 == 0, "x")
    return articles(spark, d).select("doc_id", words.language(override, F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, "pt-br"), "en").alias("lang"))


def slot_keys(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", words.slot(F.col("user_id"), F.col("event_type")).alias("slot"), words.ulid_time(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ulid"))


def json_options(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "events").select("event_id", words.options(F.col("props"), {"k": 0, "most": 3}).alias("o"))
    return o.select("event_id", "o.k", "o.most")


def target_phrases(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("doc_id", F.posexplode(words.phrases(F.col("text"))).alias("place", "phrase"))


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.substring(words.flat(F.col("html")), 1, 500).alias("text"))


def marked_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The fourth to ninth character of each title as an anchor in its context, and the title's head and tail."""
    t = articles(spark, d).where(F.length("title") >= 10)
    return t.select("doc_id", words.marked(F.col("title"), F.lit(3), F.lit(6), 2).alias("marked"), words.head(F.col("title"), 12).alias("head"), words.tail(F.col("title"), 12).alias("tail"))


def scrubbed_errors(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", words.scrubbed(F.concat(F.lit("call failed for \""), "c_name", F.lit("\" with key-"), F.col("c_mktsegment"), F.lit(" and 'x'"))).alias("message"))


def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents as a prompt and their price: languages stand for models, of which one is local and one has no price."""
    prices = spark.createDataFrame([("en", 3.0, 15.0), ("es", 1.0, 5.0), ("fr", 0.5, 2.0)], "lang string, price_in double, price_out double")
    own = articles(spark, d).select("doc_id", "lang", words.token_estimate(F.col("text"), F.col("lang")).alias("tokens"))
    c = words.cost(F.col("tokens"), F.lit(500), F.col("price_in"), F.col("price_out"), F.col("lang") == "fr")
    return own.join(F.broadcast(prices), "lang", "left").select("doc_id", "tokens", micro(c).alias("micro_cost"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a model's replies: their lines are the candidates it names, with judgements in several spellings."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_discount", "l_tax")])
    sure = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_discount") * 100).cast("int").cast("string")).otherwise(F.format_string("%.2f", F.col("l_tax").cast("double")))
    fit = F.when(F.col("l_returnflag") == "R", '"Yes"').when(F.col("l_returnflag") == "A", "false").otherwise('"maybe"')
    item = F.concat(F.lit('{"candidate": '), F.col("l_linenumber").cast("string"), F.lit(', "fit": '), fit, F.lit(', "confidence": '), sure, F.lit("}"))
    per = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("t")))), lambda x: x.t), ", ").alias("t"))  # an order has a handful of lines
    return per.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Sure, here:\n```json\n{\"results\": ["), "t", F.lit("]}\n```")).alias("text"), F.lit(5).alias("n_candidates"))


def reply_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return words.replies(_replies(spark, d)).select("id", "candidate", "fit", micro(F.col("confidence")).alias("confidence"))


def anchor_checks(spark: SparkSession, d: str) -> DataFrame:
    """Characters 3 to 12 of each title as an anchor at its place, or one to the right for odd documents; and where a proposed anchor would stand."""
    t = articles(spark, d).where(F.length("title") >= 14)
    anchor = F.substring("title", 4, 9)
    at = F.lit(3) + F.col("doc_id") % 2
    return t.select("doc_id", words.check_anchor(F.col("title"), at.cast("int"), anchor, F.col("lang")).alias("error"), words.improved_anchor(F.col("title"), F.lit(3), anchor, F.element_at(F.split("title", " "), -1)).alias("place"))


def rule_errors(spark: SparkSession, d: str) -> DataFrame:
    """Words of benchmark items as rules' variants: pieces of one to nine words, some of signs or numbers, some twice."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("rule"), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    v = b.select("rule", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array_join(F.slice("w", i % 7 + 1, i % 9 + 1), " "))).alias("place", "variant"))
    v = v.withColumn("variant", F.when(F.col("place") == 8, "a 1").when(F.col("place") == 9, F.lit("12 34")).when(F.col("place") == 10, "of the").otherwise(F.col("variant")))
    found = words.rule_errors(v.withColumn("lang", F.lit("en")).withColumn("most", (F.col("rule") % 12).cast("int")))
    return found.groupBy("rule", "error").agg(F.count("*").alias("n"))


def rule_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a rule for two types of two nations' customers doesn't apply to an order."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    c = F.col
    article = {"published": c("o_orderstatus") != "P", "ignored": c("o_orderkey") % 11 == 0, "excluded": c("c_nationkey") == 3, "type": c("o_orderpriority"), "category": c("c_mktsegment"), "lang": c("c_nationkey").cast("string")}
    rule = {"types": F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), "categories": F.array().cast("array<string>"), "langs": F.array(*[F.lit(str(i)) for i in range(15)])}
    return o.select("o_orderkey", suggest.why_not(article, rule).alias("reason"))


def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the first content word of a benchmark item's first content words."""
    terms = index.index_terms(articles(spark, d)).where("n = 1").select("doc_id", "term")
    first = F.filter(F.regexp_extract_all(words.folded(F.col("text")), F.lit(WORD), F.lit(0)), lambda w: ~F.array_contains(words.stops(F.lit("en")), w))
    rules = read(spark, d, "benchmark").select(F.col("item_id").alias("rule"), F.array_join(F.slice(first, 1, 2), " ").alias("phrase"), F.col("item_id").alias("target")).where("phrase <> ''")
    return suggest.rule_candidates(rules, terms).select("doc_id", "rule")


def rules_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of rules, the last first."""
    return read(spark, d, "benchmark").select("item_id", F.length("text").alias("chars")).orderBy(F.desc("item_id")).offset(20).limit(20)


def anchor_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor and target with how many sources link so, and the five other targets that the anchor leads to most; over five of these it's to be noted."""
    pairs = edges(spark, d).where("NOT broken").groupBy("url", "target").agg(F.countDistinct("source").alias("same"))
    by = W.partitionBy("url").orderBy(F.desc("same"), "target")
    top = pairs.withColumn("rn", F.row_number().over(by)).where("rn <= 6")  # five besides the own one
    lists = top.groupBy("url").agg(F.sort_array(F.collect_list(F.struct((-F.col("same")).alias("m"), "target"))).alias("l"))
    n = pairs.groupBy("url").agg(F.count("*").alias("targets"))
    both = pairs.join(lists, "url").join(n, "url")
    others = F.slice(F.filter("l", lambda x: x.target != F.col("target")), 1, 5)
    return both.select("url", "target", "same", F.array_join(F.transform(others, lambda x: F.concat(x.target.cast("string"), F.lit(":"), (-x.m).cast("string"))), ",").alias("elsewhere"), (F.col("targets") - 1 > 5).alias("noted"))


def links_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Each order's anchors by part, the same one in other letters once, in the order of the text."""
    lines = read(spark, d, "lineitem").withColumn("mark", F.concat("l_returnflag", "l_linestatus"))
    word = F.when(F.col("l_linenumber") % 2 == 0, F.upper("mark")).otherwise(F.lower("mark"))
    e = lines.select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), word.alias("anchor"), F.col("l_linenumber").alias("place"))
    one = e.groupBy("source", "target", words.folded(F.col("anchor")).alias("key")).agg(F.min(F.struct("place", "anchor")).alias("b"))
    return one.groupBy("source", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x.anchor), "|").alias("anchors"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Each page as the next version of the one before it."""
    p = read(spark, d, "pages").select("page_id", "html")
    return p.join(p.select((F.col("page_id") + 1).alias("page_id"), F.col("html").alias("before")), "page_id").select(F.col("page_id").alias("id"), "before", F.col("html").alias("after"))


def link_changes(spark: SparkSession, d: str) -> DataFrame:
    return words.link_changes(_versions(spark, d))


def link_log(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page as logged for the page after it."""
    return read(spark, d, "pages").select((F.col("page_id") + 1).alias("article"), F.posexplode(words.link_pairs(F.col("html"))).alias("place", "pair")).select((F.col("article") * 1000 + F.col("place")).alias("id"), "article", "pair")


def lost_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that were logged for the page before, of which the page holds none."""
    p = read(spark, d, "pages")
    return words.lost_links(link_log(spark, d), p.select(F.col("page_id").alias("article"), "html"))


def filter_to_blame(spark: SparkSession, d: str) -> DataFrame:
    """Sources that have candidates, though none from their own source: there the filter is what leaves nothing."""
    weighted, stored = index.build(articles(spark, d), stemmed=False)
    near = retrieval.similar(weighted.where("doc_id % 20 = 0"), stored, 20)
    kind = read(spark, d, "documents").select("doc_id", "source")
    both = near.join(kind.toDF("src", "a"), "src").join(kind.toDF("dst", "b"), "dst")
    return both.groupBy("src").agg(F.count_if(F.col("a") == F.col("b")).alias("left"), F.count("*").alias("all")).select("src", (F.col("left") == 0).alias("blamed"))


_ST = "coalesce(st, [])"
_PAIRS = r"""pr AS (SELECT page_id, unnest(range(len(a))) AS place, regexp_extract(unnest(a), '(?i)href="([^"]*)"', 1) || chr(31) || trim(regexp_replace(regexp_extract(unnest(a), '(?s)>([^<]*)</a>', 1), '[ \t\n\r]+', ' ', 'g')) AS pair
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>[^<]*</a>') AS a FROM pages))"""
QUERIES = {f.__name__: f for f in (content_words, verb_words, changed_documents, model_names, ignored_texts, non_content_pages, generic_anchors, normalized_titles, composed_titles, trimmed_titles, language_chain, slot_keys, json_options, target_phrases, prompt_texts, marked_anchors, scrubbed_errors, call_costs, reply_verdicts, anchor_checks, rule_errors, rule_reasons, rule_candidates, rules_page, anchor_notes, links_by_key, link_changes, lost_links, filter_to_blame)}
SQL = {
    "content_words": f"""WITH {_STOPS}, w AS (SELECT doc_id, {_ST} AS st, unnest(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{FOLDED}'), {_TOK})) AS w FROM documents LEFT JOIN stops USING (lang)),
      k AS (SELECT doc_id, CASE WHEN list_contains(st, w) THEN 0 WHEN regexp_full_match(w, '[\\p{{N}}.,]+') THEN 1 WHEN list_contains({_list(MEASURES)}, w) THEN 2 ELSE 3 END AS k FROM w)
      SELECT doc_id, count(*) AS words, count(*) FILTER (k = 0) AS stop, count(*) FILTER (k = 1) AS numbers, count(*) FILTER (k = 2) AS measures, count(*) FILTER (k = 3) AS content FROM k GROUP BY doc_id""",
    "verb_words": f"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), {_TOK})) AS w FROM documents)
      SELECT doc_id, count(*) FILTER ((lang = 'en' AND list_contains({_list(EN_VERB)}, w)) OR (lang = 'es' AND regexp_matches(w, '{ES_VERB}'))) AS verbs FROM w GROUP BY doc_id""",
    "changed_documents": "SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 6 = 0",
    "model_names": "SELECT s_suppkey, replace(lower(s_name), '#', '-') AS name FROM supplier",
    "ignored_texts": rf"SELECT doc_id FROM documents WHERE regexp_matches(' ' || string_split(text, chr(10))[1] || ' ', '(?i)[^\p{{L}}\p{{N}}](?:{'|'.join(_IGNORED)})[^\p{{L}}\p{{N}}]')",
    "non_content_pages": f"SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://x.example/Privacy/' ELSE url END AS url FROM pages) WHERE regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '{NON_CONTENT}')",
    "generic_anchors": rf"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*>([^<]*)</a>', 1) AS a FROM pages), p AS (SELECT page_id, CAST(unnest(range(len(a))) AS INTEGER) AS place, unnest(a) AS anchor FROM a)
      SELECT page_id, place, anchor FROM p WHERE trim(translate(lower(anchor), '{ACCENTED}', '{FOLDED}')) IN ('here', 'more', 'ver', 'de', 'the', 'la', 'der')""",
    "normalized_titles": f"SELECT doc_id, trim(regexp_replace(lower(translate('“' || string_split(text, chr(10))[1] || '” –  x', '{words.FANCY}', '{words.PLAIN.replace(chr(39), chr(39) * 2)}')), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS title FROM documents",
    "composed_titles": "SELECT doc_id, nfc_normalize(replace(string_split(text, chr(10))[1], 'e', 'e' || chr(769))) AS title FROM documents",
    "trimmed_titles": f"""WITH {_STOPS}, w AS (SELECT doc_id, {_ST} AS st, regexp_extract_all(lower(string_split(text, chr(10))[1]), {_TOK}) AS w FROM documents LEFT JOIN stops USING (lang)),
      c AS (SELECT doc_id, w, list_transform(w, lambda x: NOT list_contains(st, translate(x, '{ACCENTED}', '{FOLDED}'))) AS c FROM w)
      SELECT doc_id, CASE WHEN list_contains(c, true) THEN array_to_string(w[list_position(c, true):len(w) - list_position(list_reverse(c), true) + 1], ' ') END AS term FROM c""",
    "language_chain": """SELECT doc_id, coalesce(CASE WHEN doc_id % 11 = 0 THEN 'fr' END, CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 2 = 0 THEN 'pt' END, 'en') AS lang FROM documents""",
    "slot_keys": "SELECT event_id, md5(user_id || '|' || event_type) AS slot, " + " || ".join(f"substr('{words.BASE32}', CAST(((epoch_us(ts) // 1000) >> {5 * i}) & 31 AS INTEGER) + 1, 1)" for i in range(9, -1, -1)) + " AS ulid FROM events",
    "json_options": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, CAST(3 AS BIGINT) AS most FROM events",
    "target_phrases": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;.]'), lambda p: substring(trim(regexp_replace(p, '[ \t\n\r]+', ' ', 'g')), 1, 120)), lambda p: p <> '') AS p FROM documents),
      x AS (SELECT doc_id, unnest(p) AS phrase, unnest(range(len(p))) AS i FROM p), f AS (SELECT doc_id, phrase, i FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, lower(phrase) ORDER BY i) = 1)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, phrase FROM f QUALIFY place < 10""",
    "prompt_texts": r"SELECT page_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^ \t\n\r<>]+@[^ \t\n\r<>]+\.[^ \t\n\r<>]+', '', 'g'), '[ \t\n\r]+', ' ', 'g')), 1, 500) AS text FROM pages",
    "marked_anchors": """SELECT doc_id, substring(t, 2, 2) || '[[' || substring(t, 4, 6) || ']]' || substring(t, 10, 2) AS marked, CASE WHEN length(t) > 12 THEN left(t, 12) || '…' ELSE t END AS head, CASE WHEN length(t) > 12 THEN '…' || right(t, 12) ELSE t END AS tail
      FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents) WHERE length(t) >= 10""",
    "scrubbed_errors": """SELECT c_custkey, 'call failed for [text] with ' || CASE WHEN length(c_mktsegment) >= 6 THEN '[key]' ELSE 'key-' || c_mktsegment END || ' and [text]' AS message FROM customer""",
    "call_costs": """SELECT doc_id, tokens, CASE WHEN lang = 'fr' THEN CAST(0 AS BIGINT) WHEN lang = 'en' THEN CAST(floor((tokens * 3.0::DOUBLE + 500 * 15.0::DOUBLE) / 1e6 * 1e6 + 0.5) AS BIGINT) WHEN lang = 'es' THEN CAST(floor((tokens * 1.0::DOUBLE + 500 * 5.0::DOUBLE) / 1e6 * 1e6 + 0.5) AS BIGINT) END AS micro_cost
      FROM (SELECT doc_id, lang, CAST(ceil(length(text) * 10 / CASE WHEN lang = 'en' THEN 40 ELSE 36 END) AS BIGINT) AS tokens FROM documents)""",
    "reply_verdicts": """SELECT l_orderkey AS id, CAST(l_linenumber AS INTEGER) AS candidate, CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END AS fit,
      CAST(floor(CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN CAST(trunc(l_discount * 100) AS INTEGER) <= 1 THEN CAST(trunc(l_discount * 100) AS DOUBLE) ELSE trunc(l_discount * 100) / 100.0::DOUBLE END ELSE round(CAST(l_tax AS DOUBLE), 2) END * 1e6 + 0.5) AS BIGINT) AS confidence
      FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL) WHERE l_linenumber <= 5""",
    "anchor_checks": rf"""WITH {_STOPS}, t AS (SELECT doc_id, {_ST} AS st, string_split(text, chr(10))[1] AS t FROM documents LEFT JOIN stops USING (lang)), a AS (SELECT *, substring(t, 4, 9) AS a, 3 + doc_id % 2 AS spot, string_split(t, ' ')[-1] AS p, instr(lower(t), lower(string_split(t, ' ')[-1])) - 1 AS place FROM t WHERE length(t) >= 14),
      w AS (SELECT *, regexp_extract_all(lower(a), {_TOK}) AS w FROM a)
      SELECT doc_id, CASE WHEN substring(t, spot + 1, 9) <> a THEN 'literal' WHEN regexp_matches(substring(t, spot, 1), '^[\p{{L}}\p{{N}}]$') OR regexp_matches(substring(t, spot + 10, 1), '^[\p{{L}}\p{{N}}]$') THEN 'cut' WHEN length(regexp_replace(a, '[^\p{{L}}\p{{N}}]', '', 'g')) < 2 THEN 'short' WHEN len(w) > 8 THEN 'long'
        WHEN trim(translate(lower(a), '{ACCENTED}', '{FOLDED}')) IN ({", ".join(f"'{g}'" for g in words.GENERIC)}) THEN 'generic'
        WHEN len(list_filter(w, lambda x: NOT list_contains(st, translate(x, '{ACCENTED}', '{FOLDED}')) AND NOT regexp_full_match(x, '[\p{{N}}.,]+'))) = 0 THEN 'content' END AS error,
        CASE WHEN length(p) > 0 AND place >= 0 AND place < 12 AND 3 < place + length(p) AND NOT (place > 0 AND regexp_matches(substring(t, place, 1), '^[\p{{L}}\p{{N}}]$')) AND NOT regexp_matches(substring(t, place + length(p) + 1, 1), '^[\p{{L}}\p{{N}}]$') THEN CAST(place AS INTEGER) END AS place FROM w""",
    "rule_errors": rf"""WITH b AS (SELECT item_id AS rule, regexp_extract_all(lower(text), {_TOK}) AS w FROM benchmark), v0 AS (SELECT rule, unnest(range(32)) AS place, w FROM b),
      v AS (SELECT rule, place, CASE place WHEN 8 THEN 'a 1' WHEN 9 THEN '12 34' WHEN 10 THEN 'of the' ELSE array_to_string(w[place % 7 + 1:place % 7 + place % 9 + 1], ' ') END AS variant, rule % 12 AS most FROM v0),
      k AS (SELECT *, regexp_extract_all(translate(lower(variant), '{ACCENTED}', '{FOLDED}'), {_TOK}) AS w FROM v),
      e AS (SELECT rule, CASE WHEN length(variant) > 120 THEN 'long' WHEN NOT len(w) BETWEEN 1 AND 8 THEN 'words' WHEN NOT regexp_matches(variant, '\p{{L}}\p{{L}}') THEN 'letters'
        WHEN len(list_filter(w, lambda x: NOT list_contains({_list(STOP["en"])}, x) AND NOT regexp_full_match(x, '[\p{{N}}.,]+'))) = 0 THEN 'content'
        WHEN row_number() OVER (PARTITION BY rule, array_to_string(w, ' ') ORDER BY place) > 1 THEN 'repeated' WHEN place >= 30 THEN 'many' WHEN NOT most BETWEEN 1 AND 10 THEN 'most' END AS error FROM k)
      SELECT rule, error, count(*) AS n FROM e GROUP BY ALL""",
    "rule_reasons": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not published' WHEN o_orderkey % 11 = 0 THEN 'ignored' WHEN c_nationkey = 3 THEN 'excluded' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'type' WHEN c_nationkey >= 15 THEN 'language' END AS reason
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "rule_candidates": f"""{_INDEX_SQL["index_terms"].split("SELECT doc_id, term, n, title")[0]}, r AS (SELECT item_id, list_filter(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{FOLDED}'), {_TOK}), lambda x: NOT list_contains({_list(STOP["en"])}, x)) AS w FROM benchmark)
      SELECT doc_id, item_id AS rule FROM idx JOIN r ON idx.term = w[1] WHERE n = 1 AND doc_id <> item_id""",
    "rules_page": "SELECT item_id, CAST(length(text) AS INTEGER) AS chars FROM benchmark ORDER BY item_id DESC LIMIT 20 OFFSET 20",
    "anchor_notes": """WITH p AS (SELECT l_suppkey AS url, l_partkey AS target, count(DISTINCT l_orderkey) AS same FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY same DESC, target) AS rn, count(*) OVER (PARTITION BY url) AS n FROM p),
      l AS (SELECT url, list(target ORDER BY rn) AS ts, list(target || ':' || same ORDER BY rn) AS l FROM t WHERE rn <= 6 GROUP BY url)
      SELECT url, target, same, array_to_string(list_filter(l, lambda x: NOT starts_with(x, target || ':'))[1:5], ',') AS elsewhere, n - 1 > 5 AS noted FROM t JOIN l USING (url)""",
    "links_by_key": """WITH e AS (SELECT l_orderkey AS source, l_suppkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag || l_linestatus) ELSE lower(l_returnflag || l_linestatus) END AS anchor, l_linenumber AS place FROM lineitem),
      o AS (SELECT source, target, lower(anchor) AS key, min({'p': place, 'a': anchor}) AS b FROM e GROUP BY ALL) SELECT source, target, string_agg(b.a, '|' ORDER BY b.p, b.a) AS anchors FROM o GROUP BY ALL""",
    "link_changes": f"""WITH {_PAIRS}, d AS (SELECT DISTINCT page_id, pair FROM pr), ids AS (SELECT a.page_id AS id FROM pages a JOIN pages b ON a.page_id = b.page_id + 1),
      o AS (SELECT page_id + 1 AS id, pair FROM d), n AS (SELECT page_id AS id, pair FROM d),
      x AS (SELECT id, pair, true AS new FROM n SEMI JOIN ids USING (id) ANTI JOIN o USING (id, pair) UNION ALL SELECT id, pair, false FROM o SEMI JOIN ids USING (id) ANTI JOIN n USING (id, pair)),
      y AS (SELECT id, string_split(pair, chr(31))[1] AS href, string_split(pair, chr(31))[-1] AS anchor, new FROM x),
      z AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY id, anchor) = 1 AND count(*) FILTER (NOT new) OVER (PARTITION BY id, anchor) = 1 AS moved FROM y)
      SELECT id, CASE WHEN moved THEN 'retargeted' WHEN new THEN 'inserted' ELSE 'removed' END AS what, href, anchor FROM z WHERE NOT moved OR new""",
    "lost_links": f"""WITH {_PAIRS} SELECT (page_id + 1) * 1000 + place AS id FROM pr WHERE page_id + 1 IN (SELECT page_id FROM pages) AND NOT EXISTS (SELECT 1 FROM pr q WHERE q.page_id = pr.page_id + 1 AND q.pair = pr.pair)""",
    "filter_to_blame": f"""{_INDEX_SQL["index_similar"].split("SELECT src, dst, CAST(row_number()")[0]}, n AS (SELECT src, dst FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 20)
      SELECT src, count(*) FILTER (a.source = b.source) = 0 AS blamed FROM n JOIN documents a ON a.doc_id = src JOIN documents b ON b.doc_id = dst GROUP BY src""",
}
