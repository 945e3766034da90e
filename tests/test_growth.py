"""Work that must not grow with the square of a table, and tables dealt finely enough for a task's memory."""

import re
import time
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.functions import stemming
from linkloom.operators import anchors, index, positions, retrieval, suggest, terms, words
from linkloom.plans import suggest as suggest_plans
from linkloom.plans import text as text_plans
from linkloom.sources import html, tables


def _postings(spark, n):
    """Everyone holds one term, and some of a few others; a language without others, and a null one."""
    rows = [(i, "en", "all", 3) for i in range(n)] + [(i, "en", f"t{i % m}", 1 + i % 4) for i in range(n) for m in (5, 7)] + [(n, "fr", "all", 9), (n + 1, None, "all", 9)]
    return list(dict.fromkeys(rows)), spark.createDataFrame(list({r[:3]: r for r in rows}.values()), "doc_id long, lang string, term string, weight long")


def _by_force(p, k, gone=()):
    by, out = defaultdict(list), []
    for r in p.collect():
        by[(r.lang, r.term)].append((r.doc_id, r.weight))
    score = defaultdict(int)
    for (lang, _), held in by.items():
        for a, w in held:
            for b, v in held:
                if a % 20 == 0 and a != b and lang is not None and (a, b) not in gone:
                    score[a, b] += w * v
    for a in {a for a, _ in score}:
        out += sorted(((a, b, s) for (x, b), s in score.items() if x == a), key=lambda r: (-r[2], r[1]))[:k]
    return sorted(out)


@pytest.mark.parametrize("block, cells", [(4_000_000, 1 << 21), (60, 50)])
def test_similar_by_blocks(spark, monkeypatch, block, cells):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    _, p = _postings(spark, 130)
    asked, tuples = p.where("doc_id % 20 = 0"), lambda df: sorted(tuple(r) for r in df.select("src", "dst", "score").collect())
    assert tuples(retrieval.similar(asked, p, 7)) == _by_force(p, 7)
    gone = [(a, b) for a in (0, 20) for b in range(0, 130, 5)]
    assert tuples(retrieval.similar(asked, p, 7, excluded=spark.createDataFrame(gone, "src long, dst long"))) == _by_force(p, 7, gone)
    best = retrieval.scores(asked, p, least=retrieval.F.expr("max(weight) + 9"))
    top = {r.doc_id: r.m for r in asked.groupBy("doc_id").agg(retrieval.F.max("weight").alias("m")).collect()}
    assert tuples(best) == [r for r in _by_force(p, 1000) if r[2] >= top[r[0]] + 9]
    kind = p.withColumn("kind", retrieval.F.when(retrieval.F.col("doc_id") % 3 > 0, retrieval.F.col("doc_id") % 3))
    same = [(a, b) for a in range(0, 130, 20) for b in range(130) if a % 3 == b % 3]
    assert tuples(retrieval.similar(kind.where("doc_id % 20 = 0"), kind, 7, apart=True)) == _by_force(p, 7, set(same))


def test_pairs_of_a_common_term_do_not_leave_their_task(spark):
    _, p = _postings(spark, 2000)
    found = retrieval.scores(p.where("doc_id % 20 = 0"), p, 3)
    assert found.count() <= 100 * 3 * 8  # 200,000 pairs share the term
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_pass_by_a_block_of_queries(spark, monkeypatch):
    """A block of queries hands on its k best once for several blocks' worth of documents, in whatever batches they come."""
    monkeypatch.setattr(retrieval, "BLOCK", 400)
    _, p = _postings(spark, 2000)
    asked = p.where("doc_id % 20 = 0")
    assert retrieval.scores(asked, p, 3).count() <= 100 * 3 * 10  # where 6,000 postings in blocks of 400 would be 15
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in retrieval.similar(asked, p, 3).select("src", "dst", "score").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == _by_force(p, 3)


def test_anchors_keep_letters_apart(spark, duck):
    said = ["Schß", "SCHSS", "schß", "Été", "eté", "ETE", "æ", "ae", "Œuf", "oeuf", "Ñu", "nu", "ø", "o", "²", "2", "ΣΑΣ", "σας", "İ", "i"]
    got = [r.k for r in spark.createDataFrame([(x,) for x in said], "a string").select(anchors.surface(retrieval.F.col("a")).alias("k")).collect()]
    assert got == [duck.execute("SELECT lower(strip_accents(?))", [x]).fetchone()[0] for x in said]


def test_anchors_are_whole():
    page = f'<p><a href="/a">{"x" * 300} y</a> and <a href="/b"><img alt="{"z" * 300}"></a></p>'
    links = next(html._extract([pa.RecordBatch.from_pydict({"page_id": [1], "html": [page]})])).column("links").to_pylist()[0]
    assert [x["anchor"] for x in links] == ["x" * 300 + " y", "z" * 300]


def test_documents_are_found_by_all_their_terms(spark, tmp_path):
    """Also by those beyond the heaviest that are stored, and a document of the item's own number too."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(i, "en", "s", " ".join(words[::step])) for i, step in ((0, 1), (1, -1), (2, 2))]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(words)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.doc_id) for r in text_plans.containing_terms(spark, str(tmp_path)).collect()}
    assert got == {(i, d) for i in range(60) for d in (0, 1, 2) if d < 2 or i % 2 == 0}


def test_words_of_a_place_are_sent_once_for_all_targets():
    """What a source says in one place is one row, however many targets are asked for by it, and stems look for a suffix of each length once."""
    word = {"k": "mill", "s": False, "c": True, "surface": "Mill", "w": "mill", "v": False, "m": False}
    held = pa.table({"part": [0], "src": [1], "lang": ["fr"], "sentence": pa.array([0], pa.int32()), "n_sentences": pa.array([1], pa.int32()), "last": [True], "words": [[word]], "lefts": pa.array([[1]], pa.list_(pa.int32()))})
    known = pa.RecordBatch.from_pydict({"target": [2], "phrases": [["mill"]], "metas": [[1 << 3]], "expand": [[]], "lone": [["mill"]]}, pa.schema({"target": pa.int64(), "phrases": pa.list_(pa.string()), "metas": pa.list_(pa.int64()), "expand": pa.list_(pa.string()), "lone": pa.list_(pa.string())}))
    one = next(positions._hashed([known]))
    asked = pa.table({"src": [1] * 50, "dst": list(range(2, 52)), **{c: pa.concat_arrays([one.column(c)] * 50) for c in ("hashes", "metas", "expand", "lone")}})
    got = positions._searched(False)(held, asked).to_pylist()
    assert len(got) == 1 and [t["dst"] for t in got[0]["targets"]] == list(range(2, 52)) and got[0]["span"] == [word] and all(t["alone"] for t in got[0]["targets"])
    ends = stemming._ends(("ational", "ation", "al"))
    assert [stemming._longest(w, ends) for w in ("relational", "nation", "al", "l", "")] == ["ational", "ation", "al", None, None]


def test_a_target_without_similar_origins_is_no_error(spark):
    """An origin may hold a phrase of a target without sharing a term that both weigh."""
    near = spark.createDataFrame([(1, 20, 0), (2, 20, 0), (1, 40, 3), (2, 40, 6)], "src long, dst long, score long")
    assert sorted(map(tuple, suggest_plans._relevant(near, "dst").collect())) == [(1, 20, 0.0), (1, 40, 0.5), (2, 20, 0.0), (2, 40, 1.0)]


def test_texts_are_dealt_by_their_number_of_splits(spark):
    own = spark.createDataFrame([(i, "en", "a b a") for i in range(40)], "doc_id long, lang string, text string").repartition(3)
    for found in (terms.term_frequency(own), terms.ngram_terms(own)):
        assert f"hashpartitioning(doc_id#, {3 * tables.PARTS})" in re.sub(r"#\d+L?", "#", found._jdf.queryExecution().executedPlan().toString())


def test_workers_hand_on_few_pages_at_once():
    import pyarrow as pa

    pages = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(["<p>a <a href='/x'>b</a></p>"] * 999 + [None])], ["page_id", "html"])
    got = list(html._extract([pages]))
    assert max(b.num_rows for b in got) <= html.PAGES and sum(b.num_rows for b in got) == 999
    assert got[0].to_pylist()[0] == {"page_id": 0, "block": 0, "kind": "paragraph", "area": "body", "text": "a b", "links": [{"href": "/x", "s": 2, "e": 3, "anchor": "b"}]}


def test_workers_remember_words_up_to_a_bound(monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(index, "BATCH_CHARS", 100)
    monkeypatch.setattr(index, "DICTIONARY_WORDS", 50)
    monkeypatch.setattr(index, "_Dictionary", lambda stemmed, kind=index._Dictionary: made.append(kind(stemmed)) or made[-1])
    index.analyzer.known.cache_clear()
    batch = pa.record_batch([pa.array(range(200), pa.int64()), pa.array(["en"] * 200), pa.array([f"w{i}a w{i}b w{i}c" for i in range(200)]), pa.nulls(200, pa.string())], ["doc_id", "lang", "text", "focus"])
    assert sum(b.num_rows for b in index._analyse(False)([batch])) == 200 * 6
    assert len(made) > 5 and max(len(x.key) for x in made) < 100 and not index.analyzer.known.cache_info().currsize


def test_phrases_take_time_in_proportion_to_a_text(spark):
    texts = [("A b, a  B;c. ,c ,d", ["A b", "c", "d"]), (", ;", []), ("", []), ("same," * 20_000 + "last", ["same", "last"]), (",".join(f"p{i}" for i in range(20_000)), [f"p{i}" for i in range(10)])]
    df = spark.createDataFrame(texts, "t string, want array<string>")
    began = time.time()
    assert all(r.got == r.want for r in df.select(words.phrases(retrieval.F.col("t")).alias("got"), "want").collect())
    assert time.time() - began < 30  # not the square of 20,000 parts


def test_weights_by_blocks_equal_those_by_rows(spark, monkeypatch):
    monkeypatch.setattr(index, "BATCH_CHARS", 40)
    monkeypatch.setattr(index, "BLOCK_WORDS", 60)
    texts = [(i, ["en", "es", None, "xx"][i % 4 if i % 3 else 0], " ".join(f"w{(i * j) % 13} the a{i % 5}," for j in range(i % 9)) + f"\nHead w{i % 4}\n" + "w1 w2 of w3 " * (i % 6), "w1 w2" if i % 2 else None) for i in range(120)] + [(200, "en", "", None), (201, "fr", "1 2", None), (202, "en", None, None)]
    own = spark.createDataFrame(texts, "doc_id long, lang string, text string, focus string").repartition(3)
    for stemmed in (False, True):
        want = index.weights(own, index.index_terms(own, stemmed))
        found = index.weighed(own, stemmed, k=5)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, found.drop("rank").collect())) and want.count() > 500
        best = {}
        for row in want.where("NOT casual").collect():
            best.setdefault(row.doc_id, []).append((-row.weight, row["first"], row.term))
        ranks = {(x.doc_id, x.term): x["rank"] for x in found.where("rank IS NOT NULL").collect()}
        assert ranks == {(d, t): i + 1 for d, held in best.items() for i, (*_, t) in enumerate(sorted(held)[:5])}
        some = index.weighed(own, stemmed, (20, 0), k=5)
        assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, found.where("doc_id % 20 = 0 OR rank IS NOT NULL").collect()), key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((lang|term|doc_id)", plan)  # no term crosses the network
    assert index.weighed(own.limit(0), False).count() == 0


def test_weights_of_words_by_blocks_equal_those_by_rows(spark):
    texts = [(i, ["en", "es", None, "xx"][i % 4 if i % 3 else 0], " ".join(f"w{(i * j) % 13} The a{i % 5}," for j in range(i % 9))) for i in range(120)] + [(200, "en", ""), (201, "fr", "1 2"), (202, "fr", "...")]
    own = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3)
    tf = terms.term_frequency(own)
    want = terms.weights(tf, terms.document_frequency(tf), own.select("lang"))
    found = terms.weighed(own)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, found.drop("rank").collect())) and want.count() > 300
    top = sorted(map(tuple, terms.top_terms(want, 5).collect()))
    assert top == sorted((r.doc_id, r.lang, r.term, r.weight, r["rank"] - 1) for r in found.where("rank <= 5").collect())
    some = terms.weighed(own, (20, 0), k=5)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, found.where("doc_id % 20 = 0 OR rank <= 5").collect()))
    assert not re.search(r"hashpartitioning\((lang|term)", found._jdf.queryExecution().executedPlan().toString())
    assert terms.weighed(own.limit(0)).count() == 0


def test_phrases_cross_the_network_without_their_keys(spark):
    held = positions.positions(positions.sentences(spark.createDataFrame([(1, "en", "A stone bridge.")], "doc_id long, lang string, text string"))).withColumnRenamed("doc_id", "src")
    asked = spark.createDataFrame([(1, 2, "stone bridge", 2, "title", False, 0)], "src long, dst long, phrase string, words int, kind string, gap boolean, ord int")
    found = positions.find(held, asked, spark.createDataFrame([], "target long, expand array<string>, lone array<string>"))
    assert [r.anchor for r in found.collect()] == ["stone bridge"]
    assert not re.search(r"hashpartitioning\(src#\d+L?, key#", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("stemmed", [False, True])
def test_phrases_are_searched_by_blocks_of_sources(spark, monkeypatch, stemmed):
    """Blocks give what each place that meets a first key does, also where a source with many pairs is in several, and no word of a text crosses the network."""
    monkeypatch.setattr(positions, "PAIRS", 7)
    monkeypatch.setattr(positions, "SOURCES", 3)
    own = tables.articles(spark, "/root/testdata/sf0.001").where("doc_id < 40").withColumn("focus", F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(F.split("text", "[^a-z]+"), 3, 2), " ")))
    pairs = own.select(F.col("doc_id").alias("src")).crossJoin(own.select(F.col("doc_id").alias("dst"))).where("src <> dst AND (src % 10 = 0 OR (src + dst) % 9 = 0)")
    stored = index.build(own, stemmed)[1]
    phrases, grown = positions.target_phrases(own, stored, stemmed=stemmed), positions.expansions(own, stored)
    places = positions.positions(positions.sentences(own), stemmed).withColumnRenamed("doc_id", "src")
    want = positions.find(places, pairs.join(phrases.withColumnRenamed("target", "dst"), "dst"), grown)
    found = positions.search(own, pairs, phrases, grown, stemmed=stemmed)
    got = sorted(map(str, found.select(want.columns).collect()))
    assert got == sorted(map(str, want.collect())) and len(got) > 100
    plan = suggest.anchors(pairs, own, stored, stemmed=stemmed)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("Exchange hashpartitioning" in a and re.search(r"ahead#|lefts#", b) for a, b in zip(plan, plan[1:], strict=False))


ODD = [
    "A, b;c -d 'e' f-g h'i j’’k -- l.m\tn o, - p (- q", ", x ,", "ΑΣ ΑΣ'Α, ΣΑΣ İstanbul Été ñandú STRASSE straße", "Mail a@b.org, or www.x.org/y?z Www.Q.com. HTTPS://A.b c @ d :// e www. f",
    "www.x.org", "***\n...\n1. One! two? three… (four) \"five.\" Six", "été ² ½ x² Ⅷ 𝒜b 😀c d😀 ''g", "", None, "-a- 'b' ’c", "a,'b,-c, 'd - e,' -", "x\x02y\x03z. A\x03 b\r\nc",
]


def test_places_are_those_of_positions(spark):
    own = spark.createDataFrame([(i, ["en", None, "es"][i % 3], t) for i, t in enumerate(ODD)], "doc_id long, lang string, text string")
    held, cols = positions.sentences(own), ["doc_id", "sentence", "place", "key", "break"]
    tuples = lambda df: sorted(map(tuple, df.select(cols).collect()))
    got = tuples(positions.places(held))
    assert got == tuples(positions.positions(held)) and len(got) == 60
    text = {(r.doc_id, r.sentence): r.text for r in held.collect()}
    words = defaultdict(list)
    for d, s, _, key, parted in got:
        words[d, s].append((key, parted))
    runs = {(r.doc_id, r.sentence): r.runs for r in held.select("doc_id", "sentence", positions.keys.runs(retrieval.F.col("text")).alias("runs")).collect()}
    assert set(text) == set(runs)
    for at, of in runs.items():
        folded = [r.k for r in spark.createDataFrame([(w,) for run in of for w in run], "w string").select(positions.keys.folded(retrieval.F.col("w")).alias("k")).collect()] if of else []
        assert words[at] == list(zip(folded, [i == 0 and j > 0 for j, run in enumerate(of) for i in range(len(run))], strict=True))


def test_texts_are_taken_apart_once(spark):
    own = spark.createDataFrame([(1, "en", "A stone bridge. It fell.")], "doc_id long, lang string, text string")
    plan = positions.places(positions.sentences(own))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("|mlle|") == 1 and "find_in_set" not in plan  # sentences are found once, and no kinds of words
    held = positions.positions(positions.sentences(own), True)
    for asked in (held.where("NOT linked AND NOT stop"), held.join(spark.createDataFrame([("stone",)], "key string"), "key"), held.where("ahead[0].c AND ks[0] = key")):
        plan = asked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("|mlle|") == 1 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("by", [" ", ", "])
def test_positions_take_time_and_memory_in_proportion_to_a_sentence(spark, by):
    own = spark.createDataFrame([(1, "en", by.join(f"w{i}" for i in range(20_000)))], "doc_id long, lang string, text string")
    held, began = positions.sentences(own), time.time()
    got = positions.positions(held).select(*map(retrieval.F.expr, ["count(*)", "sum(place)", "sum(size(ahead))", "sum(size(ks))", "count_if(break)", "count_if(ahead[0].k = key AND ks[0] = key)"])).first()
    ahead = 20_000 * 11 - 55 if by == " " else 20_000
    assert tuple(got) == (20_000, sum(range(20_000)), ahead, ahead, 0 if by == " " else 19_999, 20_000)
    assert time.time() - began < 30
