"""Operators against examples worked out by hand."""

import math

from pyspark.sql import functions as F

from linkloom.operators import graph, history, retrieval, terms, urls


def docs(spark, *texts):
    return spark.createDataFrame([(i + 1, "xx", t.split("\n")[0], t) for i, t in enumerate(texts)], "doc_id long, lang string, title string, text string")


def test_bm25_by_hand(spark):
    own = docs(spark, "alfa alfa beta", "gamma beta beta gamma", "delta alfa delta")
    tf = terms.term_frequency(own)
    df = terms.document_frequency(tf)
    assert {r.term: r.df for r in df.collect()} == {"alfa": 2, "beta": 2}
    got = {(r.doc_id, r.term): r.weight for r in terms.weights(tf, df, own.select("lang")).collect()}
    want = math.log(1 + 1.5 / 2.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / (10 / 3)))
    assert got[2, "beta"] == math.floor(want * 1e6 + 0.5)


def test_ngrams_stop_at_signs(spark):
    got = {r.term for r in terms.ngram_terms(docs(spark, "puente de piedra, viejo")).collect()}
    assert "puente de piedra" in got and "piedra viejo" not in got


def test_merge_of_partial_counts(spark):
    tf = terms.term_frequency(docs(spark, "a b", "a c", "a b"))
    whole = terms.document_frequency(tf, 1)
    parts = terms.merge_frequency(terms.document_frequency(tf.where("doc_id < 3"), 1), terms.document_frequency(tf.where("doc_id = 3"), 1))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_status_matrix(spark):
    cases = [((0, 9, 100), "orphan"), ((1, 9, 100), "low"), ((2, 2, 100), "over"), ((2, 1, 50), "ok"), ((5, 3, 300), "ok"), ((5, 4, 300), "over")]
    df = spark.createDataFrame([c for c, _ in cases], "inbound long, outbound long, words long")
    assert [r.s for r in df.select(graph.status(F.col("inbound"), F.col("outbound"), F.col("words")).alias("s")).collect()] == [s for _, s in cases]


def test_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 1.0]), (4, 0, None), (5, 1, [1.0, 0.0])], "id long, part int, vector array<float>")
    got = [tuple(r) for r in retrieval.nearest(v, v.where("id = 1"), 3).orderBy("rank").collect()]
    assert got == [(1, 2, 1, 1000000), (1, 3, 2, 0), (1, 4, 3, 0)]


def test_blend_keeps_lexical_without_vector(spark):
    df = spark.createDataFrame([(0.4, 0.8), (0.4, None)], "a double, b double")
    assert [round(r.x, 6) for r in df.select(retrieval.blend(F.col("a"), F.col("b")).alias("x")).collect()] == [0.6, 0.4]


def test_classifier(spark):
    cases = {"#top": "skip", "": "skip", "mailto:a@b.c": "skip", "/a.pdf": "skip", "/a": "internal", "https://www.Site.org/x": "internal", "//other.org/": "external", "?p=2": "internal", "a/b": "internal"}
    df = spark.createDataFrame([(k,) for k in cases], "href string")
    got = {r.href: r.k for r in df.select("href", urls.kind(F.col("href"), F.lit("site.org")).alias("k")).collect()}
    assert got == cases
    one = spark.createDataFrame([("HTTPS://www.site.org/a/?utm_source=x&id=3#y",)], "href string")
    assert one.select(urls.normal(F.col("href"), F.lit("site.org"))).first()[0] == "site.org/a?id=3"


def test_slots_keep_the_last_change(spark):
    c = spark.createDataFrame([(1, 7, "add", False), (2, 7, "add", True), (3, 8, "add", False)], "id long, article long, action string, undone boolean")
    assert [r.id for r in history.live(c).collect()] == [3]


def test_pace_without_movement(spark):
    s = spark.createDataFrame([(1, 10, 5), (1, 20, 15), (2, 10, 5)], "job int, at_s long, done long")
    assert sorted(tuple(r) for r in history.pace(s, 100).collect()) == [(1, 3600, 100), (2, None, None)]


def test_edges_of_a_batch_are_replaced(spark):
    old = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "source int, target int")
    after, affected = graph.replace_edges(old, spark.createDataFrame([(1, 9)], "source int, target int"))
    assert sorted(map(tuple, after.collect())) == [(1, 9), (4, 2)] and {r.target for r in affected.collect()} == {2, 3, 9}


def test_score_by_hand(spark):
    from linkloom.operators import suggest

    df = spark.createDataFrame([(0.5, "ngram", 1, 3, 0.8, False, 400, 11, 1000, 6, False, False)], "relevance double, kind string, anchor_words int, inbound int, position double, last boolean, age_days int, source_links int, source_words int, anchor_uses int, unlike boolean, penalized boolean")
    value = df.select(suggest.score({c: F.col(c) for c in df.columns})).first()[0]
    assert abs(value - (0.55 * 0.5 + 0.25 * 0.7 + 0.05 * 0.25 + 0.10 * 0.6 - 0.2 - 0.1)) < 1e-12


def test_one_suggestion_a_sentence_and_a_phrase(spark):
    from linkloom.operators import suggest

    s = spark.createDataFrame([(1, 10, 0, "A", "a", 90), (1, 11, 0, "b", "b", 80), (1, 12, 1, "a", "a", 70), (1, 13, 2, "c", "c", 60), (2, 10, 0, "a", "a", 5)], "src long, dst long, sentence int, anchor string, phrase string, score long")
    assert sorted((r.src, r.dst, r["rank"]) for r in suggest.choose(s).collect()) == [(1, 10, 1), (1, 13, 2), (2, 10, 1)]


RULES = "rule int, phrase string, target long"


def test_rules_keep_their_limits(spark):
    from linkloom.operators import rules

    own = docs(spark, "Stone bridge here. Old mill there.\nA stone bridge, old mill again at www.x.org now.", "no such thing", "old mill " + "word " * 250 + ". Stone bridge.")
    asked = spark.createDataFrame([(1, "stone bridge", 9), (2, "stone bridge", 1), (3, "old mill", 3), (4, "old mill", 8)], RULES)
    links = spark.createDataFrame([(7, 1)], "doc_id long, n long")
    plan = lambda **kw: sorted(tuple(r) for r in rules.plan(asked, own, links, **kw).collect())
    # one for each hundred words; of rules with one phrase the smallest that leads elsewhere
    assert plan() == [(1, 1, 0, "Stone bridge"), (1, 3, 1, "Stone bridge"), (4, 3, 0, "old mill")] == plan(most=1)
    assert plan(ignored=["STONE"]) == [(3, 1, 1, "Old mill"), (4, 3, 0, "old mill")]
    sites = spark.createDataFrame([("stone bridge", 9, 5), ("old mill", 8, 4)], "phrase string, target long, n long")
    assert plan(sites=sites) == [(3, 1, 1, "Old mill"), (4, 3, 0, "old mill")]
    saved = spark.createDataFrame([(3,), (3,), (99,)], "doc_id long")
    assert sorted(tuple(r) for r in rules.apply_saved(asked, own, saved, links).collect()) == [(1, 3, 1, "Stone bridge"), (4, 3, 0, "old mill")]


def test_rules_by_force(spark):
    """Every phrase at every place, by comparison; then the places in order, one link after the other."""
    import random

    from linkloom.operators import rules

    rng = random.Random(8)
    word = lambda: rng.choice(["red", "blue", "old", "mill", "stone", "bridge"])
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    asked = sorted({(i, " ".join(word() for _ in range(rng.randint(1, 3))), rng.randint(1, 9)) for i in range(25)})
    want, places = [], []
    for d, text in enumerate(texts, 1):
        room, picked = max(1, len(text.split()) // 100), []
        for s, sentence in enumerate(text.split("\n")):
            w = sentence.split()
            for i in range(len(w)):
                for n in range(3, 0, -1):
                    phrase = " ".join(w[i : i + n])
                    if i + n > len(w) or all(p != phrase for _, p, _ in asked):
                        continue
                    places.append((d, s, i, phrase))
                    hit = min(((r, t) for r, p, t in asked if p == phrase and t != d), default=None)
                    if hit and len(picked) < room and all(s > x or i >= y for x, y, *_ in picked[-1:]) and all(hit[0] != r and hit[1] != t for *_, r, t in picked):
                        picked.append((s, i + n, *hit))
                        want.append((hit[0], d, s, phrase))
    frame, none = spark.createDataFrame(asked, RULES), spark.createDataFrame([], "doc_id long, n long")
    for most in (1000, 3):  # an automaton, and a join by the first key
        got = rules.matches(frame, docs(spark, *texts), most=most).select("doc_id", "sentence", "place", "phrase").collect()
        assert sorted(map(tuple, got)) == sorted(places)
        assert sorted(map(tuple, rules.plan(frame, docs(spark, *texts), none, most=most).collect())) == sorted(want)


def test_english_stems():
    from linkloom.functions.stemming import english

    pairs = "caresses:caress ponies:poni ties:tie cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing hopping:hop falling:fall hoping:hope happy:happi relational:relat conditional:condit valenci:valenc digitizer:digit triplicate:triplic hopeful:hope goodness:good revival:reviv adjustable:adjust adoption:adopt probate:probat controll:control roll:roll generously:generous skies:sky"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert english(word) == stem, (word, english(word))


def test_stream_equals_batch(spark, tmp_path):
    from linkloom.streaming import incremental

    source = str(tmp_path / "in")
    own = docs(spark, "a b", "b c", "a b c").select("doc_id", "lang", "text")
    own.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = incremental.stream_frequencies(stream, str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, terms.document_frequency(terms.term_frequency(own), 1).collect()))
    assert incremental.stale(6, 100, 100) and not incremental.stale(2, 102, 100)


def test_blocks_and_links(spark):
    from linkloom.sources.html import blocks

    html = '<html><head><title>T &amp; t</title><style>x{}</style></head><body><h1>Head</h1><p>See <a href="/a"><b>the</b> page</a>, and <a href="/b"><img src="x" alt="pic"></a>.</p><script>no()</script>tail <a href="/c">open</body>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = blocks(df).collect()
    assert [(r.kind, r.text) for r in got] == [("title", "T & t"), ("heading", "Head"), ("paragraph", "See the page, and ."), ("paragraph", "tail open")]
    assert [(x.href, x.anchor) for r in got for x in r.links] == [("/a", "the page"), ("/b", "pic"), ("/c", "open")]
    assert got[2].text[got[2].links[0].s : got[2].links[0].e] == "the page"


def test_incoming_looks_at_all_origins(spark):
    from linkloom.plans import registry
    from tests.conftest import DATA

    got = registry.QUERIES["incoming_suggestions"](spark, DATA).collect()
    assert any(r.src % 20 for r in got) and all(r.target % 20 == 0 for r in got)
    assert len({(r.src, r.target) for r in got}) == len(got)


def test_outgoing_looks_beyond_the_five_nearest(spark):
    from linkloom.plans import registry
    from tests.conftest import DATA

    near = {(r.src, r.dst) for r in registry.QUERIES["similar_documents"](spark, DATA).collect()}
    assert {(r.src, r.dst) for r in registry.QUERIES["outgoing_suggestions"](spark, DATA).collect()} - near
