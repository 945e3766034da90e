"""Periodic runs, BPE and whitening, against brute force and the tokenizer's own library."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import bpe, periodic, whitening
from linkloom.llm.tables import table
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda b: hashlib.sha256(b).hexdigest()


def runs_by_force(w):
    """(start, length, period): every stretch of equal words q apart, by its smallest q."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def random_texts(rng, most=6):
    out = []
    for _ in range(rng.randint(1, most)):
        k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 20, 60, 150])
        w = [str(rng.randrange(k)).encode() for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 4 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = b"z"
        out.append(w)
    return out + out[:1] * rng.randrange(2)


def test_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        texts = random_texts(rng)
        for text, got in zip(texts, periodic._find(texts), strict=True):
            assert [tuple(r) for r in got.tolist()] == runs_by_force(text)


def test_reach_is_the_longest_common_extension():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4):
        texts = [rng.integers(0, k, rng.integers(1, 80)) for _ in range(5)]
        sequence, ends, _ = periodic._joined(texts)
        grammar = periodic.Grammar(sequence, ends)
        assert [len(s) for s in grammar.symbols] == sorted((len(s) for s in grammar.symbols), reverse=True)
        i, j = np.array([(a, b) for a in range(1, len(sequence) - 1) for b in range(a + 1, len(sequence) - 1)]).T
        for way in (1, -1):
            want = []
            for a, b in zip(i, j, strict=True):
                n = 0
                while sequence[a + way * n] == sequence[b + way * n]:
                    n += 1
                want.append(n)
            assert grammar.reach(i, j, way).tolist() == want


def test_runs_in_long_texts_and_tables():
    rng = random.Random(5)
    long = [b"%d" % rng.randrange(30000) for _ in range(60_000)]
    long = long[:20_000] + long[:700] * 30 + long[20_000:]
    rows = [b"|" if i % 3 == 0 else b"%d" % rng.randrange(9000) for i in range(60_000)]  # every third word is the same, and nothing repeats
    got = periodic._find([long, rows])
    assert [r[1:].tolist() for r in got[0]] == [[21_000, 700]] and not len(got[1])


def test_collapse(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y", "k"), (2, None, None), (None, "", "k"), (1, "x a b a b a b a b y", "k"), (3, "w " * 9, "é"), (4, "a b\x85a b　c\ra\x0bb", "")], "doc_id long, text string, Runs string")
    out = periodic.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert got == [(1, 10, [(1, 8, 2)], "x a b y"), (2, 0, [], ""), (None, 0, [], ""), (1, 10, [(1, 8, 2)], "x a b y"), (3, 9, [(0, 9, 1)], "w"), (4, 5, [], "a b\x85a b　c a b")]
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_op11_by_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(texts)
    some = 0
    for doc, text in texts.items():
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_force(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode())
        assert r.collapsed_sha256 == sha(b" ".join(x for i, x in enumerate(w) if i not in gone))
        some += bool(runs)
    assert some > 10


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_of_random_texts(coder, library):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "<|endoftext|>", "<|endof", "'s", "'ll", "1", "ß", "日", "　", "\r\n", "!", "aaaa", "\x1c", "\x85", "\U0001f600", "hello", " world"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    got = [x.tolist() for x in coder.encode(texts)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for ids in got:
        rng.shuffle(ids)  # decoded, these needn't be UTF-8
        assert coder.decode(ids[:7]).decode() == library.decode(ids[:7], skip_special_tokens=False)


def test_bpe_of_every_character(coder, library):
    texts = [f"a{c}b1{c}2,{c}, {c}{c} {c}" for c in map(chr, [*range(0x3100), *range(0xA000, 0xA100), *range(0xFE00, 0x10300), *range(0x1F600, 0x1F650)])]
    assert [x.tolist() for x in coder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_a_long_word(coder, library):
    text = "abc" * 30_000 + " " + "é" * 5000
    assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_forgets(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_STRETCHES", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    texts = [f"word{i} other{i % 3} " + "x" * 100 for i in range(40)]
    assert [coder.encode([t])[0].tolist() for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_rows(spark):
    docs = spark.createDataFrame([(1, "Hi there", "k"), (2, None, None), (None, "", "k"), (1, "Hi there", "k")], "doc_id long, text string, `IDS` string")
    held = bpe.encode(docs, PATH)
    assert held.columns == ["doc_id", "text", "ids"]
    assert [(r.doc_id, r.decoded) for r in bpe.decode(held, PATH).collect()] == [(1, "Hi there"), (2, ""), (None, ""), (1, "Hi there")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()[0].decoded is None


def test_op12_as_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    got = {r.doc_id: r for r in bpe.op12_bpe(spark, DATA).collect()}
    assert len(got) == len(texts)
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(decoded))


def exact(vectors):
    """Whole entries, sums, and the covariance by products of centred entries, all exact."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = [[Fraction(n * c - s, n) for c, s in zip(v, sums, strict=True)] for v in x]
    d = len(sums)
    return x, sums, [[sum(v[i] * v[j] for v in centred) / n for j in range(d)] for i in range(d)]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "t") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, X string")


@pytest.mark.parametrize("far", [0.0, 1e6, 3e12])
def test_whitening_by_force(spark, far):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    vectors = [[float(np.float32(c + (far if i == 1 else 0) * (1 + k % 2))) for i, c in enumerate(v)] for k, v in enumerate(mixed)]
    docs = frame(spark, vectors).repartition(3)
    model = whitening.fit(docs)
    x, sums, v = exact(vectors)
    n = len(x)
    assert (model.n, model.sums) == (n, sums)
    e = np.linalg.eigvalsh(np.array(v, dtype=float))[::-1]
    k = len(model.explained)
    assert k == 5 or far == 3e12 and k >= 1
    np.testing.assert_allclose(model.explained, e[:k] / e.sum(), rtol=1e-4)
    rows = {r.vec_id: r for r in whitening.whiten(docs, model).collect()}
    for i, own in enumerate(x):
        assert int(rows[i].deviation) == sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))
    white = np.array([rows[i].whitened for i in range(n)])
    assert abs(white.mean(0)).max() < 1e-3 and abs(white.T @ white / n - np.eye(k)).max() < 1e-4 and model.identity_error < 1e-4


def test_covariance_is_rounded_once(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 4)).astype(np.float32).tolist()
    x = np.array(exact(vectors)[0])
    n, sums = len(x), x.sum(0).tolist()
    centre = [s // n for s in sums]
    y = x - centre
    squares = [int((y[:, i] ** 2).sum()) for i in range(4)] + [int(((y[:, i] + y[:, j]) ** 2).sum()) for i in range(4) for j in range(i + 1, 4)]
    got = whitening.covariance(n, [s - n * m for s, m in zip(sums, centre, strict=True)], squares)
    assert got.tolist() == [[float(c) for c in row] for row in exact(vectors)[2]]
    assert whitening._added(whitening.whole(frame(spark, vectors).repartition(3), "embedding"), whitening._squares(centre)) == squares


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [None, 0.0]), (6, []), (7, [1.0, 3.0]), (None, [1.0, 2.0]), (7, [1.0, 3.0])], "vec_id long, embedding array<float>")
    model = whitening.fit(docs)
    assert model.n == 4 and model.explained == [1.0]  # one dimension doesn't vary
    assert sorted(str(r.vec_id) for r in whitening.whiten(docs, model).collect()) == ["1", "7", "7", "None"]
    for none in (docs.limit(0), docs.where("vec_id = 2")):
        model = whitening.fit(none)
        assert model.n == 0 and whitening.whiten(none, model).count() == 0
    alike = whitening.fit(docs.where("vec_id = 7"))
    assert alike.n == 2 and alike.explained == [] and [r.whitened for r in whitening.whiten(docs.where("vec_id = 7"), alike).collect()] == [[], []]
    with pytest.raises(ValueError, match="one length"):
        whitening.fit(docs.union(spark.createDataFrame([(8, [1.0])], docs.schema)))


def test_op13(spark):
    out = whitening.op13_embedding_whitening(spark, DATA)
    vectors = [r.embedding for r in table(spark, DATA, "embeddings").collect()]
    fine = [v for v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    assert out.count() == 32 * len(fine)
    r = out.agg(F.max("identity_error").alias("e"), F.min("n").alias("n"), F.countDistinct("component").alias("k"), F.sum("explained").alias("s")).first()
    assert r.e < 1e-4 and r.n == len(fine) and r.k == 32
