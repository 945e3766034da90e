"""Words, names and small texts as Spark expressions: predicates, keys, cleaning, snippets, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.lexicon import EN_VERB, ES_VERB, GENERIC, MEASURES, NON_CONTENT, STOP
from linkloom.functions.text import ACCENTED, FOLDED, WORD

#: Typographic signs and what they become; the last three vanish.
FANCY, PLAIN = "’‘‚“”„«»–—−­​﻿", "'''\"\"\"\"\"---"
#: Fixed value: the alphabet of Crockford's base 32.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def folded(word: Column) -> Column:
    return F.translate(F.lower(word), ACCENTED, FOLDED)


def _folded_list(words: str) -> Column:
    return F.array(*[F.lit(w) for w in sorted({w.translate(str.maketrans(ACCENTED, FOLDED)) for w in words.split()})])


def stops(lang: Column) -> Column:
    """The folded stop words of a language; none of one that has no list."""
    out = F.array().cast("array<string>")
    for name, words in STOP.items():
        out = F.when(lang == name, _folded_list(words)).otherwise(out)
    return out


def word_kinds(articles: DataFrame) -> DataFrame:
    """doc_id, words, stop, numbers, measures, content: a word that is none of these is content. Lists meet the words in a broadcast join."""
    spark = articles.sparkSession
    listed = [(lang, w.translate(str.maketrans(ACCENTED, FOLDED)), "stop") for lang, words in STOP.items() for w in words.split()]
    known = spark.createDataFrame(sorted(set(listed)), "lang string, word string, kind string")  # some hundreds of rows
    word = articles.select("doc_id", "lang", F.explode(F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0))).alias("word"))
    met = word.join(F.broadcast(known), ["lang", "word"], "left")
    stop, number, measure = F.col("kind").isNotNull(), F.col("word").rlike(r"^[\p{N}.,]+$"), F.array_contains(_folded_list(MEASURES), F.col("word"))
    return met.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count_if(stop).alias("stop"), F.count_if(~stop & number).alias("numbers"), F.count_if(~stop & ~number & measure).alias("measures"), F.count_if(~stop & ~number & ~measure).alias("content")
    )


def verb_like(word: Column, lang: Column) -> Column:
    """Whether a lowered word looks like a verb's form: by a list for English, by its ending for Spanish."""
    return F.when(lang == "en", word.isin(*EN_VERB.split())).when(lang == "es", word.rlike(ES_VERB)).otherwise(False)


def model_name(name: Column) -> Column:
    """A model's name without its provider, date and case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^.*/", ""), r"[-@:_](?:\d{8}|\d{4}-\d{2}-\d{2}|latest)$", "")


def generic(anchor: Column, words: tuple[str, ...] = GENERIC) -> Column:
    return F.trim(folded(anchor)).isin(*words)


def non_content(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^?#]*", 0)).rlike(NON_CONTENT)


def normalized(text: Column) -> Column:
    """Typographic signs made plain, soft hyphens and zero-width spaces gone, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, FANCY, PLAIN)), r"[ \t\n\r\f\x0B]+", " "))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed letters; only texts that hold a combining mark go through Python."""
    return F.when(text.rlike(r"\p{M}"), _nfc(text)).otherwise(text)


def trimmed(title: Column, lang: Column) -> Column:
    """The words of a text without stop words at either end, joined by spaces; null where none is left."""
    words = F.regexp_extract_all(F.lower(title), F.lit(WORD), F.lit(0))
    content = F.transform(words, lambda w: ~F.array_contains(stops(lang), folded(w)))
    first = F.array_position(content, True)
    last = F.size(words) - F.array_position(F.reverse(content), True) + 1
    return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), (last - first + 1).cast("int")), " "))


def language(override: Column, given: Column, detected: Column, site: str) -> Column:
    """The first that is a code of two or three letters, regions cut off, of an override, the given, the detected and the site's."""
    code = lambda c: F.nullif(F.regexp_extract(F.lower(c), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))
    return F.coalesce(code(override), code(given), code(detected), F.lit(site))


def slot(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def ulid_time(millis: Column) -> Column:
    """The ten characters that stand for a time in a ULID."""
    digits = [F.substring(F.lit(BASE32), (F.shiftright(millis, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(9, -1, -1)]
    return F.concat(*digits)


def options(json: Column, defaults: dict[str, int]) -> Column:
    """A struct of whole numbers from JSON; what is missing, or no number, takes its default."""
    parsed = F.from_json(json, ", ".join(f"{k} bigint" for k in defaults))
    return F.struct(*[F.coalesce(parsed[k], F.lit(v).cast("long")).alias(k) for k, v in defaults.items()])


def phrases(text: Column, most: int = 10, chars: int = 120) -> Column:
    """The parts of a text between commas, semicolons and full stops: tidied, cut to a length, without repeats in any case, the first `most`."""
    parts = F.transform(F.split(text, r"[,;.]"), lambda p: F.substring(F.trim(F.regexp_replace(p, r"[ \t\n\r]+", " ")), 1, chars))
    new = lambda kept, p: (F.size(kept) < most) & (p != "") & ~F.exists(kept, lambda x: F.lower(x) == F.lower(p))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda kept, p: F.when(new(kept, p), F.concat(kept, F.array(p))).otherwise(kept))


def flat(html: Column) -> Column:
    """Text for a prompt: tags and e-mails out, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[^ \t\n\r<>]+@[^ \t\n\r<>]+\.[^ \t\n\r<>]+", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))


def marked(sentence: Column, at: Column, length: Column, window: int = 60) -> Column:
    """A sentence around its anchor (from place `at`, counted from 0), the anchor in double brackets."""
    start = F.greatest(at - window, F.lit(0))
    return F.concat(F.substring(sentence, start + 1, at - start), F.lit("[["), F.substring(sentence, at + 1, length), F.lit("]]"), F.substring(sentence, at + length + 1, F.lit(window)))


def head(text: Column, chars: int = 70) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def tail(text: Column, chars: int = 70) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.lit("…"), F.right(text, F.lit(chars)))).otherwise(text)


def scrubbed(message: Column) -> Column:
    """An error's text without keys and without what it quotes."""
    bare = F.regexp_replace(message, r"(?i)\b(?:sk|key|token|bearer)[-_= ][A-Za-z0-9_-]{6,}", "[key]")
    return F.regexp_replace(bare, "\"[^\"]*\"|'[^']*'|«[^»]*»", "[text]")


def token_estimate(text: Column, lang: Column) -> Column:
    return F.ceil(F.length(text) * 10 / F.when(lang == "en", 40).otherwise(36))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, local: Column) -> Column:
    """Price for a million tokens each way; null where it isn't known, 0 for a local model."""
    return F.when(local, F.lit(0.0)).otherwise((tokens_in * price_in + tokens_out * price_out) / 1e6)


def replies(texts: DataFrame) -> DataFrame:
    """id, candidate, fit (true, false or null), confidence (0 to 1, null if it is none): of a model's reply (id, text, n_candidates).

    The JSON object is looked for inside whatever stands around it; candidates that weren't asked are left out, of repeats the first stays.
    """
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    item = "candidate string, fit string, confidence string"
    parsed = F.from_json(body, f"results array<struct<{item.replace(' string', ': string')}>>")
    rows = texts.select("id", "n_candidates", F.posexplode(parsed.results).alias("place", "r"))
    number = F.col("r.candidate").try_cast("int")
    word = F.lower(F.trim("r.fit"))
    fit = F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)
    raw = F.col("r.confidence").try_cast("double")
    sure = F.when(raw.between(0, 1), raw).when((raw > 1) & (raw <= 100), raw / 100)
    good = rows.select("id", "place", number.alias("candidate"), fit.alias("fit"), sure.alias("confidence"), "n_candidates").where(F.col("candidate").between(1, F.col("n_candidates")))
    return good.groupBy("id", "candidate").agg(F.min_by(F.struct("fit", "confidence"), "place").alias("b")).select("id", "candidate", "b.fit", "b.confidence")


def improved_anchor(sentence: Column, at: Column, original: Column, proposed: Column) -> Column:
    """The place (from 0) of a proposed anchor in the sentence if it overlaps the original one and cuts no word, else null."""
    place = F.instr(F.lower(sentence), F.lower(proposed)) - 1
    end = place + F.length(proposed)
    word = lambda c: F.coalesce(c, F.lit("")).rlike(r"^[\p{L}\p{N}]$")
    cut_left = word(F.substring(sentence, place, F.lit(1))) & (place > 0)
    cut_right = word(F.substring(sentence, end + 1, F.lit(1)))
    return F.when((place >= 0) & (F.length(proposed) > 0) & (place < at + F.length(original)) & (at < end) & ~cut_left & ~cut_right, place)


def check_anchor(sentence: Column, at: Column, anchor: Column, lang: Column) -> Column:
    """The first error of an anchor at a place (from 0) of its sentence, null if it has none: literal, cut, short, long, generic, content."""
    end = at + F.length(anchor)
    word = lambda c: c.rlike(r"^[\p{L}\p{N}]$")
    words = F.regexp_extract_all(F.lower(anchor), F.lit(WORD), F.lit(0))
    content = F.exists(words, lambda w: ~F.array_contains(stops(lang), folded(w)) & ~w.rlike(r"^[\p{N}.,]+$"))
    return (
        F.when((F.length(anchor) == 0) | (F.substring(sentence, at + 1, F.length(anchor)) != anchor), "literal")
        .when(((at > 0) & word(F.substring(sentence, at, F.lit(1)))) | word(F.substring(sentence, end + 1, F.lit(1))), "cut")
        .when(F.length(F.regexp_replace(anchor, r"[^\p{L}\p{N}]", "")) < 2, "short").when(F.size(words) > 8, "long").when(generic(anchor), "generic").when(~content, "content")
    )


def rule_errors(variants: DataFrame) -> DataFrame:
    """rule, variant, error: why a variant (rule, place, variant, lang, most) can't be one, null if it can. `most`: the rule's links per article.

    Checked in order: length over 120 characters, 1 to 8 words, two letters in a row, a content word, an earlier variant of the same words,
    the thirtieth variant passed, most between 1 and 10.
    """
    words = F.regexp_extract_all(folded(F.col("variant")), F.lit(WORD), F.lit(0))
    key = F.array_join(words, " ")
    again = F.row_number().over(W.partitionBy("rule", "key").orderBy("place"))
    content = F.exists("w", lambda w: ~F.array_contains(stops(F.col("lang")), w) & ~w.rlike(r"^[\p{N}.,]+$"))
    error = (
        F.when(F.length("variant") > 120, "long").when(~F.size("w").between(1, 8), "words").when(~F.col("variant").rlike(r"\p{L}\p{L}"), "letters").when(~content, "content")
        .when(F.col("again") > 1, "repeated").when(F.col("place") >= 30, "many").when(~F.col("most").between(1, 10), "most")
    )
    return variants.withColumns({"w": words, "key": key}).withColumn("again", again).select("rule", "variant", error.alias("error"))


def link_pairs(html: Column) -> Column:
    """The (href, text) pairs of a text's links, as strings with a unit separator; hrefs in double quotes, white space collapsed."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))
    text = lambda a: F.trim(F.regexp_replace(F.regexp_extract(a, r"(?s)>([^<]*)</a>", 1), r"[ \t\n\r]+", " "))
    return F.transform(found, lambda a: F.concat(F.regexp_extract(a, r'(?i)href="([^"]*)"', 1), F.lit("\x1f"), text(a)))


def link_changes(versions: DataFrame) -> DataFrame:
    """id, what (inserted, removed, retargeted), href, anchor: how the links of a text changed (id, before, after).

    An anchor that had one address before and has one other now was retargeted.
    """
    side = lambda c, name: versions.select("id", F.explode(F.array_distinct(link_pairs(F.col(c)))).alias("pair")).withColumn(name, F.lit(True))
    both = side("before", "old").join(side("after", "new"), ["id", "pair"], "full").where("old IS NULL OR new IS NULL")
    parts = both.select("id", F.substring_index("pair", "\x1f", 1).alias("href"), F.substring_index("pair", "\x1f", -1).alias("anchor"), F.col("new").isNotNull().alias("new"))
    w = W.partitionBy("id", "anchor")
    moved = (F.count_if("new").over(w) == 1) & (F.count_if(~F.col("new")).over(w) == 1)
    what = F.when(moved, F.when(F.col("new"), "retargeted")).when(F.col("new"), "inserted").otherwise("removed")
    return parts.withColumn("what", what).where("what IS NOT NULL").select("id", "what", "href", "anchor")


def lost_links(log: DataFrame, content: DataFrame) -> DataFrame:
    """id: entries of a log (id, article, pair) whose link is no longer in the article's content (article, html): they count as undone."""
    held = content.select("article", F.explode(link_pairs(F.col("html"))).alias("pair")).distinct()
    return log.join(content.select("article"), "article", "left_semi").join(held, ["article", "pair"], "left_anti").select("id")
