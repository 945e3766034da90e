"""Learned operators: held-out accuracy, and defined results for null, empty and clashing input."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import langid, language_model, quality, toxicity
from tests.conftest import DATA


def read(spark, name, sf=DATA.replace("0.001", "0.01")):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def odd(spark):
    return spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "123 ...", 0.5), (None, "the", 0.5), (4, "the of and " * 30000, 0.5)], "doc_id long, text string, lang_pred double")


def test_languages_held_out(spark):
    docs = read(spark, "documents")
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    got = langid.identify(docs.where("doc_id % 3 = 1"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.lang_score.between(0, 1).all()
    seen = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(odd(spark), model).collect()}
    assert seen[1] == seen[2] == seen[3] == ("und", 0.0) and seen[4][0] == "en"
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd(spark), nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_languages_by_force(spark):
    """Another naive Bayes over the same n-grams, in plain loops."""
    docs = read(spark, "documents").where("doc_id % 20 < 3 AND n_chars < 3000")
    rows = docs.collect()
    learn = [r for r in rows if r.doc_id % 3 != 1 and r.lang]

    def features(text):
        data = bytes(text or "", "utf-8")
        data = bytes(b + 32 if 65 <= b < 91 else b for b in data)
        out = Counter()
        for n in langid.SIZES:
            code = np.array([int.from_bytes(data[i : i + n], "big") for i in range(len(data) - n + 1)], np.uint64)
            out.update((langid.mix(code + np.uint64(n << 32)) % np.uint64(langid.FEATURES)).tolist())
        return out

    langs = sorted({r.lang for r in learn})
    counts = {x: np.full(langid.FEATURES, langid.SMOOTHING) for x in langs}
    prior = Counter(langs)
    for r in learn:
        prior[r.lang] += 1
        for f, n in features(r.text.replace("\n", "\n")).items():
            counts[r.lang][f] += n
    logp = {x: np.log(c / c.sum()) for x, c in counts.items()}
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    same = 0
    for r in rows:
        f = features(r.text)
        total = {x: sum(n * logp[x][k] for k, n in f.items()) + math.log(prior[x] / sum(prior.values())) for x in langs}
        same += got[r.doc_id].lang_pred == max(langs, key=total.get)
    assert same >= len(rows) - 1  # the matrix is of single precision


def test_query_of_languages(spark):
    got = {r.doc_id: r for r in langid.op2_language_id(spark, DATA).collect()}
    docs = {r.doc_id: r for r in read(spark, "documents", DATA).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or ""))
    right = [got[i].lang_pred == d.lang for i, d in docs.items() if d.lang and got[i].held_out and got[i].lang_pred != "und"]
    assert np.mean(right) > 0.95


def test_texts_without_letters(spark):
    model = langid.fit(read(spark, "documents"))
    rows = spark.createDataFrame([(1, "½ ²"), (2, "①"), (3, "Ⅷ"), (4, "日"), (5, "the"), (5, "the"), (6, "ªº")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(rows, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and "und" not in (got[4], got[5], got[6])
    tie = langid.fit(spark.createDataFrame([("abc", "xx"), ("abc", "aa")], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(rows.where("doc_id = 5"), tie).collect()} == {"aa"}


def test_toxicity_grades(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        g = i % 4 if i % 4 < 3 else 0
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range((0, 2, 12)[g]):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(w), True))
        labels.append((i, g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, grade int"))
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    held = [(g, got[i]) for i, g in labels[400:]]
    assert np.mean([r.grade == g for g, r in held]) > 0.95
    mean = [np.mean([r.severity for g, r in held if g == k]) for k in range(3)]
    assert mean[0] < 0.2 < mean[1] < mean[2] <= 2
    assert (np.diff(model[1].thresholds) > 0).all()
    low = {r.doc_id: r.toxic for r in toxicity.grade(odd(spark), model).collect()}
    assert not any(low.values())
    twice = toxicity.grade(docs.limit(1).unionByName(docs.limit(1)), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and toxicity.grade(docs.limit(0), model).count() == 0
    blank = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.toxic for r in toxicity.grade(odd(spark), blank).collect())


def test_equal_texts_vote(spark):
    rows = [(i, f"calm words {i % 7} here" if i % 3 else f"vile {i % 11} nasty thing") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and not (i % 11 == 5 and i % 2))) for i, _ in rows], "doc_id long, toxic int")  # of one text half the labels are toxic
    one, two = (toxicity.fit(docs.repartition(k), labels.repartition(k)) for k in (1, 5))
    assert (one[0].codes == two[0].codes).all() and np.allclose(one[1].weights, two[1].weights)
    assert len(one[1].thresholds) == 2


def test_quality_statistics_by_force(spark):
    rng = random.Random(4)
    texts = [(1, None), (2, ""), (3, "a b c d e a b c d e"), (4, "x\nx\n \ny\nx"), (5, "# * é% ÉA!"), (6, "a " * 20000)]
    texts += [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(10, 60)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, n_words int")
    for r in quality.statistics(docs).collect():
        t = dict(texts)[r.doc_id] or ""
        w = t.encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        from collections import Counter

        n = Counter(grams)
        repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(set(w)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_distinct) == want, r.doc_id


def test_query_of_quality(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents", DATA).collect()}
    got = quality.op6_quality_rules(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        w = (docs[r.doc_id] or "").encode().split()
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rules_held_out(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.apply_rules(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "rule", "base_failed").toPandas()
    caught = got.rule.notna()
    assert (got.quality[caught] == 0).mean() > 0.95
    assert (caught | got.base_failed)[got.quality == 0].mean() > 0.9
    assert quality.fit(docs, labels.limit(0)) == []
    assert quality.apply_rules(docs.limit(0), rules).count() == 0
    odd_ = spark.createDataFrame([(1, "a b", True, 3), (1, "a b", True, 3), (None, "a b", False, 1)], "doc_id long, text string, kept boolean, rule int")
    same = quality.apply_rules(odd_, rules).collect()
    assert len(same) == 3 and {(r.base_failed, r.kept) for r in same} == {(True, False)} and same[0] == same[1]


def words_of(text):
    return [x.lower() for x in (text or "").encode().split()]


def shares(model, context):
    """The probabilities of all symbols after this context, from what scoring uses."""
    names, (h, c, v), (keys, gain), (back, parent), _, _ = model.fixed
    p = 10 ** (back[context] + parent)
    low = context << language_model.PAIR_BITS
    at = np.flatnonzero((keys >= low) & (keys < low + (1 << language_model.PAIR_BITS)))
    p[keys[at] - low] *= 10 ** gain[at]
    return p


def test_language_model(spark):
    docs = read(spark, "documents")
    learn, held = docs.where("doc_id % 5 <> 1"), docs.where("doc_id % 5 = 1")
    model = language_model.fit(learn)
    got = {r.doc_id: r for r in language_model.score(held, model).collect()}

    # the base columns by force
    n = Counter(w for r in learn.collect() for w in words_of(r.text) + [b"\n"])
    tokens, distinct = sum(n.values()), len(n)
    for r in held.collect():
        text = words_of(r.text) + [b"\n"]
        have = got[r.doc_id]
        assert (have.n_tokens, have.n_known, have.train_tokens) == (len(text), sum(w in n for w in text), tokens)
        assert math.isclose(have.base_score, sum(math.log10((n[w] + 0.5) / (tokens + 0.5 * (distinct + 1))) for w in text), rel_tol=1e-9)

    assert sum(r.score for r in got.values()) > 0.99 * sum(r.unigram_score for r in got.values())  # of negative numbers: better than without contexts

    # every context's distribution adds up to one, as do the words of the symbol for others with those that are new
    for context in [0, 5, len(model.fixed[0]) - 1, language_model.END, language_model.TAIL]:
        assert math.isclose(shares(model, context).sum(), 1.0, rel_tol=1e-6)

    # the order of words counts, and beats the words alone
    texts = [(r.doc_id, r.text) for r in held.collect() if r.text and len(r.text) > 200]
    rng = random.Random(1)
    mixed = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in texts], "doc_id long, text string")
    other = {r.doc_id: r.score for r in language_model.score(mixed, model).collect()}
    assert sum(got[i].score > other[i] + 0.1 for i in other) > 0.9 * len(other)
    _, _, _, (_, parent), _, _ = model.fixed
    alone = [10**x for x in parent]
    assert math.isclose(sum(alone), 1.0, rel_tol=1e-6)


def test_new_words_are_scored_by_their_spelling(spark):
    learn = spark.createDataFrame([(i, "the house stands on the hill and the mouse runs home " * 5) for i in range(20)], "doc_id long, text string")
    model = language_model.fit(learn)
    new = spark.createDataFrame([(1, "house"), (2, "hound"), (3, "zqxjk")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(new, model).collect()}
    assert got[1] > got[2] > got[3]


def test_language_model_edge_cases(spark):
    model = language_model.fit(read(spark, "documents"))
    seen = language_model.score(odd(spark), model).collect()
    by = {r.doc_id: r for r in seen}
    assert by[1].n_tokens == by[2].n_tokens == 1 and by[1].score == by[2].score < 0 and by[4].n_tokens == 90001
    twice = spark.createDataFrame([(7, "a b", 1), (7, "a b", 2), (7, "c", 3), (None, "a b", 4), (None, None, 5)], "doc_id long, text string, score int")
    assert sorted((str(r.doc_id), r.n_tokens) for r in language_model.score(twice, model).collect()) == [("7", 2), ("7", 3), ("7", 3), ("None", 1), ("None", 3)]
    assert language_model.score(odd(spark).limit(0), model).count() == 0
    nothing = language_model.fit(read(spark, "documents").limit(0))
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in language_model.score(odd(spark), nothing).collect())


def test_a_sweep_leaves_the_exact_posterior(spark):
    """Two dishes of three and two customers in one restaurant: table numbers against all seatings of the customers."""
    d, base, theta = 0.4, np.array([0.3, 0.2]), language_model.STRENGTH

    def partitions(n):
        if n == 0:
            return [[]]
        return [p[:i] + [p[i] + 1] + p[i + 1 :] for p in partitions(n - 1) for i in range(len(p))] + [p + [1] for p in partitions(n - 1)]

    def block(p):
        out = 1.0
        for size in p:
            for i in range(1, size):
                out *= i - d
        return out

    exact = Counter()
    for a in partitions(3):
        for b in partitions(2):
            new = math.prod(theta + d * i for i in range(1, len(a) + len(b)))
            exact[len(a), len(b)] += new * block(a) * block(b) * base[0] ** len(a) * base[1] ** len(b)
    whole = sum(exact.values())
    rng, runs = np.random.default_rng(3), 4000
    room = np.repeat(np.arange(runs), 2)  # restaurants side by side
    c, t = np.tile([3, 2], runs), np.ones(2 * runs, np.int64)
    seen = Counter()
    for step in range(60):
        t = language_model.sweep(c, t, np.tile(base, runs), room, np.bincount(room, t), d, rng)
        if step >= 20:
            seen.update(zip(t[::2].tolist(), t[1::2].tolist()))
    for k, v in exact.items():
        assert abs(seen[k] / sum(seen.values()) - v / whole) < 0.01, k


@pytest.mark.parametrize("d", [0.2, 0.7])
def test_seating_grows_like_the_process(d):
    rng = np.random.default_rng(1)
    one = language_model.forward(np.full(300, 2000), np.full(300, 0.5), d, rng)
    exact = []
    for _ in range(300):
        t = 1
        for c in range(1, 2000):
            t += rng.random() < 0.5 / (c - d * t + 0.5)
        exact.append(t)
    assert abs(one.mean() - np.mean(exact)) < 4 * (np.std(exact) + np.std(one)) / 300**0.5
