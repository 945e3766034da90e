"""The text engine by force: sentences, keys, index terms, anchors, alternatives, stemmers, writes."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.functions import analyzer
from linkloom.functions.stemming import spanish
from linkloom.operators import index, positions, store, suggest, words


def docs(spark, *texts, lang="en"):
    return spark.createDataFrame([(i + 1, lang, "s", t.split("\n")[0], t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, title string, text string")


def test_spanish_stems():
    pairs = "chicas:chic chico:chic chicharrones:chicharron chilenos:chilen torneado:torn tormenta:torment torneos:torne toros:tor toronto:toront cheques:chequ chequeo:cheque tornillos:tornill torres:torr torrencial:torrencial tórrido:torr"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert spanish(word) == stem, (word, spanish(word))


def test_sentences():
    text = "Dr. Ruiz met J. Smith at 3.5 km. It rained!  «Why?» he said. no.\nNew line… end\n1. First item\n***"
    got = [text[a:b].strip() for a, b, _ in analyzer.sentences(text)]
    assert got == ["Dr. Ruiz met J. Smith at 3.5 km.", "It rained!", "«Why?» he said. no.", "New line… end", "1. First item"]
    assert [last for *_, last in analyzer.sentences(text)] == [False, False, False, False, True]
    assert analyzer.sentences("") == []


def test_addresses_are_no_words():
    found = analyzer.runs("See www.a.org/x or me@b.com today", "en", False)
    assert [[t.surface for t in run] for run in found] == [["See"], ["or"], ["today"]]


def test_index_terms_by_force(spark):
    own = docs(spark, "Stone bridges\nThe old stone bridge of Dover\nIt was the bridge of the 12 km, stone and bridge again and again", None or "x")
    got = {r.term: r for r in index.index_terms(own.where("doc_id = 1")).collect()}
    assert got["stone bridges"].title == 1 and got["stone bridge"].heading == 1 and got["stone"].title + got["stone"].heading + got["stone"].body == 3
    assert "bridge of dover" in got and "the bridge" not in got and "12" not in got and "12 km" not in got and "km stone" not in got
    assert got["stone bridges"].first < got["old stone"].first
    stems = {r.term for r in index.index_terms(own, stemmed=True).collect()}
    assert "stone bridg" in stems or "stone bridge" in stems


def test_weights_by_hand(spark):
    own = docs(spark, "alfa\nbeta beta gamma delta epsilon zeta eta theta", "alfa\nbeta", "alfa\nkappa lambda mu nu xi omicron pi")
    terms = index.index_terms(own)
    got = {(r.doc_id, r.term): r.weight for r in index.weights(own, terms).collect()}
    average = (9 + 2 + 8) / 3
    norm = 1.2 * (0.25 + 0.75 * 9 / average)
    assert got[1, "alfa"] == math.floor(math.log(1 + 0.5 / 3.5) * 3 * 2.2 / (1 + norm) * 1e6 + 0.5)
    assert got[1, "beta"] == math.floor(math.log(1 + 1.5 / 2.5) * 2 * 2.2 / (2 + norm) * 1e6 + 0.5)
    assert (1, "gamma") not in got


def test_anchors_keep_the_order_of_rejection(spark):
    own = docs(spark, "Title here\nThe stone bridge is old. Click here for more. Visit www.x.org for the stone bridge.\nWas stone bridge.", "Stone bridge\nbody", "Click here\nbody")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    bridg = analyzer.known("bridge", "en", True)[0]
    stored = spark.createDataFrame([(2, "en", "stone", 1, 9, 0, 0), (2, "en", bridg, 1, 8, 0, 1)], "doc_id long, lang string, term string, n int, weight long, title long, pos int")
    got = sorted((r.dst, r.sentence, r.anchor, r.kind, r.last) for r in suggest.anchors(pairs, own.withColumn("focus", F.lit(None).cast("string")), stored).collect())
    assert (2, 1, "stone bridge", "title", False) in got and (2, 4, "stone bridge", "title", True) in got  # one in each paragraph
    assert all(s != 3 for _, s, *_ in got)  # the sentence with an address
    assert all(d == 2 for d, *_ in got)  # `click here` is generic
    assert (2, 1, "stone", "unigram", False) in got


ASKED = "src long, dst long, phrase string, words int, kind string, gap boolean, ord int"


def found(spark, text, asked, expand=(), lone=(), lang="en", used=None):
    """What positions.find says of one text: (anchor, kind, gapped, expanded)."""
    held = positions.positions(positions.sentences(docs(spark, text, lang=lang))).withColumnRenamed("doc_id", "src")
    rows = spark.createDataFrame([(1, 2, p, len(p.split()), kind, gap, i) for i, (p, kind, gap) in enumerate(asked)], ASKED)
    grown = spark.createDataFrame([(2, list(expand), list(lone))], "target long, expand array<string>, lone array<string>")
    got = positions.find(held, rows, grown, used).orderBy("sentence", "place", "words").collect()
    return [(r.anchor, r.kind, r.gapped, r.expanded) for r in got]


def test_phrases_with_one_word_between(spark):
    asked = [("kitchen renovation", "focus", True)]
    assert found(spark, "A kitchen renovation and a kitchen full renovation.", asked) == [("kitchen renovation", "focus", False, False), ("kitchen full renovation", "focus", True, False)]
    assert found(spark, "A kitchen very full renovation, a kitchen, renovation, a kitchen is renovation.", asked) == []  # two words, a sign, a verb between
    assert found(spark, "A kitchen full renovation.", [("kitchen renovation", "title", False)]) == []


def test_anchors_grow_by_a_word_of_the_title(spark):
    asked = [("heat pump", "title", False)]
    assert found(spark, "A heat pump air system. A heat pump, air.", asked, expand=["air"]) == [("heat pump air", "title", False, True), ("heat pump", "title", False, False)]


def test_refused_anchors(spark):
    one = lambda text, phrase, **kw: found(spark, text, [(phrase, "ngram", False)], **kw)
    assert one("Power of 12 km here", "12 km") == [] and one("Over 100 km of road", "km of road") == []  # no content at the start
    assert one("A walk of km", "walk of km") == [] and one("Walk march", "walk march") == []  # a unit or a month at the end
    assert one("Dogs make", "dogs make") == []  # a verb
    assert one("Click here", "click here") == [] and one("X", "x") == []
    assert one("Stone bridge at www.a.org", "stone bridge") == []  # the sentence holds a link
    used = lambda dst: spark.createDataFrame([(1, "stone bridge", dst)], "src long, key string, dst long")
    assert one("Stone bridge", "stone bridge", used=used(9)) == [] and one("Stone bridge", "stone bridge", used=used(2)) == [("Stone bridge", "ngram", False, False)]


def test_the_last_phrase_of_one_place_wins(spark):
    got = found(spark, "Heat pump air.", [("heat pump air", "title", False), ("heat pump", "ngram", False)], expand=["air"])
    assert got == [("Heat pump air", "ngram", False, True)]


def test_longest_phrase_with_a_gap(spark):
    eight = "alfa beta gama delta epsilon zeta eta theta"
    assert found(spark, eight.replace("beta", "beta new") + ".", [(eight, "focus", True)]) == [(eight.replace("beta", "beta new"), "focus", True, False)]
    assert found(spark, eight + " iota.", [(eight, "title", False)], expand=["iota"]) == []  # it would grow beyond the most words


def test_target_phrases(spark):
    own = docs(spark, "The stone bridge, of Dover\nx").withColumn("focus", F.lit("Stone Bridge"))
    stored = spark.createDataFrame([(1, "en", "dover", 1, 9, 1, 0), (1, "en", "old mill", 2, 8, 0, 1), (1, "en", "mill", 1, 5, 0, 12)], "doc_id long, lang string, term string, n int, weight long, title long, pos int")
    got = {(r.phrase, r.kind, r.gap) for r in positions.target_phrases(own, stored).collect()}
    assert got == {("stone bridge", "title", True), ("dover", "title", False), ("old mill", "ngram", False)}
    assert {(r.phrase, r.kind) for r in positions.target_phrases(own, stored.where("pos > 0")).collect()} == {("stone bridge", "title"), ("old mill", "ngram")}  # a word alone must be stored


def test_native_sentences_are_those_of_the_analyzer(spark):
    texts = ["Dr. Ruiz met J. Smith at 3.5 km. It rained!  «Why?» he said. no.\nNew line… end\n1. First item\n***", "", "a.. B. c.\n(dr. X) etc. Then e.g. this… And?!\" So", "\n\n", "Fin.\u00a0Otra. pág. 3. Él"]
    want = [(i + 1, n, t[a:b].strip(), last) for i, t in enumerate(texts) for n, (a, b, last) in enumerate(analyzer.sentences(t))]
    got = positions.sentences(docs(spark, *texts), starts=True).orderBy("doc_id", "sentence").collect()
    assert [(r.doc_id, r.sentence, r.text, r.last) for r in got] == want
    for r in got:
        assert texts[r.doc_id - 1].split("\n")[r.line][r.start :].startswith(r.text)


def test_alternatives(spark):
    cols = "src long, dst long, sentence int, start int, anchor string, phrase string, words int, score long"
    scored = spark.createDataFrame([(1, 10, 0, 0, "A", "a", 1, 900), (1, 10, 1, 0, "B", "b", 1, 850), (1, 10, 1, 5, "C", "c", 1, 840), (1, 10, 2, 0, "D", "d", 1, 100), (1, 10, 3, 0, "X", "x", 1, 880), (1, 11, 3, 0, "X", "x", 1, 700)], cols)
    chosen = spark.createDataFrame([(1, 10, 0, "A", "a", 900), (1, 11, 3, "X", "x", 700)], "src long, dst long, sentence int, anchor string, phrase string, score long")
    got = [tuple(r) for r in suggest.alternatives(scored, chosen, margin=100).collect()]
    assert got == [(1, 10, 1, "B", "b")]
    left = suggest.without_ignored(chosen, ["a"], spark.createDataFrame([(99,)], "id long")).collect()
    assert [r.dst for r in left] == [11]


def test_csv_writer(spark, tmp_path):
    t = spark.createDataFrame([(1, '=1+1, "x"'), (2, None), (3, "plain")], "id long, title string")
    store.write_csv(t.coalesce(1), ["id", "title"], str(tmp_path / "out"), bom=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8")
    assert text.splitlines() == ["﻿id,title", "1,\"'=1+1, \"\"x\"\"\"", "2,", "3,plain"]


@pytest.mark.parametrize(("reply", "want"), [('{"results":[{"candidate":1,"fit":"yes","confidence":80},{"candidate":9},{"candidate":1,"fit":false}]}', [(1, True, 0.8)]), ("no json", []), ('x {"results":[{"candidate":"2","confidence":"0.5"}]} y', [(2, None, 0.5)]), (None, [])])
def test_replies(spark, reply, want):
    t = spark.createDataFrame([(1, reply, 3)], "id long, text string, n_candidates int")
    assert [(r.candidate, r.fit, r.confidence) for r in words.replies(t).collect()] == want


def test_language_of_codes(spark):
    t = spark.createDataFrame([("ES_mx", "en", None), ("x", "de-AT", None), (None, None, "fr"), (None, "", None)], "o string, l string, d string")
    assert [r.x for r in t.select(words.language(F.col("o"), F.col("l"), F.col("d"), "en").alias("x")).collect()] == ["es", "de", "fr", "en"]


def test_terms_are_counted_once_a_document(spark):
    own = docs(spark, "a1 b1\na1 c1 a1", "a1")
    n = Counter()
    for r in index.index_terms(own).where("n = 1").collect():
        n[r.doc_id, r.term] += 1
    assert set(n.values()) == {1} and index.index_terms(own.limit(0)).count() == 0
