"""Substring dedup, SimHash and components against brute force, with nulls, empty, repeated and very long texts."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import simhash, substring
from linkloom.llm.components import components
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, kept_text string, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA)


def cut_by_force(texts, n):
    first = {}
    for i, t in texts:
        w = t.encode().split() if t is not None and i is not None else []
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, t in texts:
        w = (t or "").encode().split()
        gone = {q for p in range(len(w) - n + 1) if i is not None and first[tuple(w[p : p + n])] < i for q in range(p, p + n)}
        out[i] = (len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ä", "b", "ccc", "ß9", "."]) + str(rng.randrange(6))
    passages = [[word() for _ in range(rng.randrange(45, 130))] for _ in range(5)]
    texts = []
    for i in range(40):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(30)
            w += [word() for _ in range(rng.randrange(40))] + p[a : a + rng.randrange(40, 120)]
        texts.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    texts += [(100, None), (101, ""), (102, " \n "), (103, texts[3][1]), (104, " ".join(["x"] * 3000)), (105, " ".join(["x"] * 200)), (None, texts[3][1])]
    want = cut_by_force(texts, 50)
    got = substring.substring_dedup(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, b" ".join((r.kept_text or "").encode().split()).decode()) == want[r.doc_id], r.doc_id
        if not r.n_removed:
            assert r.kept_text == dict(texts)[r.doc_id]
    assert set(got[0].asDict()) == {"doc_id", "text", "extra", "kept_text", "n_words", "n_removed"}


def test_cover_meets_at_every_shift():
    d = set(substring.COVER)
    assert {(a - b) % substring.PERIOD for a in d for b in d} == set(range(substring.PERIOD))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring.substring_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.similar_groups(none).count() == 0


def fingerprint(text):
    w = bytes((text or "").encode()).lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hashes_of_spans():
    rng = random.Random(9)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2900) for _ in range(800)])
    end = start + np.array([rng.randrange(1, 70) for _ in range(800)])
    got = simhash.xxh64(np.frombuffer(raw, np.uint8), start, end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(start, end)]


def groups_by_force(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, f in prints:
        for b, g in prints:
            if bin(f ^ g).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def test_fingerprints_and_groups(spark):
    rng = random.Random(5)
    texts = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "a b"), (5, "a b c")]
    for i in range(10, 70):
        w = [f"w{rng.randrange(50)}" for _ in range(150)]
        texts.append((i, " ".join(w)))
        for j in range(rng.randrange(3)):
            v = list(w)
            v[rng.randrange(150)] = "changed"
            texts.append((i * 10 + j + 1000, "\n".join(v)))
    prints = [(i, fingerprint(t)) for i, t in texts]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert {i: f for i, (f, _) in got.items()} == dict(prints)
    assert {i: c for i, (_, c) in got.items()} == groups_by_force(prints)


def test_balls_find_every_pair_within_three_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in (1, 2, 3, 4)]
    prints = [x - 2**64 if x >= 2**63 else x for x in base + near]
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()}
    want = groups_by_force([(x, x & (2**64 - 1)) for x in sorted(prints)])
    assert all(found.get(x, x) == want[x] for x in prints)


def test_fingerprints_of_null_ids_repeated_and_long_rows(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    texts = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (7, long), (8, long + " end"), (None, "alone in here"), (9, None), (10, "")]
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(frame(spark, texts)).collect()))
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 7), (8, 7), (9, 9), (10, 9)]


def test_query_of_fingerprints(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in docs}
    want = groups_by_force(sorted(prints.items()))
    got = simhash.op9_simhash_near_dedup(spark, DATA).collect()
    assert len(got) == len(docs)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_groups_of_similar_texts(spark):
    rng = random.Random(2)
    texts, want = [], {}
    for i in range(30):
        w = [f"w{rng.randrange(1000)}" for _ in range(300)]
        texts.append((i, " ".join(w)))
        v = list(w)
        for p in rng.sample(range(300), 3):  # J of 5-word shingles about 0.9
            v[p] = "changed"
        texts.append((100 + i, " ".join(v)))
        texts.append((200 + i, " ".join(f"v{rng.randrange(1000)}" for _ in range(300))))
        want |= {i: i, 100 + i: i, 200 + i: 200 + i}
    texts += [(500, texts[0][1]), (501, None), (502, "")]
    want |= {500: 0, 501: 501, 502: 501}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()}
    assert got == want


def test_digest_matches_kept_words(spark):
    texts = [(1, "a  b\nc"), (2, None)]
    from linkloom.llm.tables import SPACE

    cut = substring.substring_dedup(frame(spark, texts))
    got = {r.doc_id: r.s for r in cut.select("doc_id", F.sha2(F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), SPACE, " ")), 256).alias("s")).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_majority():
    h = np.array([3, 1, 1], np.uint64)
    assert simhash.majority(h, np.array([0, 3]), np.array([3, 0])).tolist() == [1, 0]


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def similar_by_force(texts, least=0.8):
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, t) in enumerate(texts):
        for b, u in texts[:k]:
            if jaccard(t, u) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in texts}


def test_similarity_is_exact_around_the_threshold(spark):
    rng = random.Random(11)
    texts = []
    for i in range(80):
        w = [f"w{i}x{p}" for p in range(204)]  # 200 shingles; an end cut by c leaves 200 - c of them
        texts += [(i, " ".join(w)), (100 + i, " ".join(w[: 204 - rng.choice([36, 38, 40, 41, 42, 44])]))]
    want = similar_by_force(texts)
    assert 0 < sum(a != b for a, b in want.items()) < 80
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()} == want


def test_crowded_buckets_lose_no_pair(spark):
    rng = random.Random(12)
    frame_ = [f"t{p}" for p in range(160)]
    texts = []
    for i in range(260):  # all share most of their words, but are not alike
        own = [f"w{i}x{p}" for p in range(44)]
        texts.append((i, " ".join(frame_ + own)))
        if i % 5 == 0:  # a pair of over 0.8
            texts.append((1000 + i, " ".join(frame_ + own[:25] + [f"v{i}x{p}" for p in range(rng.choice([15, 19]))])))
    want = similar_by_force(texts)
    assert sum(a != b for a, b in want.items()) == 52
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()} == want


def test_groups_are_joined_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    words = [f"t{p}" for p in range(200)]
    texts = [(i, " ".join(words[:-4] + [f"w{i}"])) for i in range(120)] + [(1000 + i, " ".join(f"x{i}y{p}" for p in range(50))) for i in range(10)]
    slim = frame(spark, texts)
    marked = slim.mapInArrow(simhash._sketches(5), "doc_id long, fp long, whole long, size int, bands array<long>, low array<int>")
    found = simhash._untested(slim, marked, spark.createDataFrame([], "node long, root long"), 5, 0.8)
    assert found.count() < 120 * simhash.BANDS * 8  # 7,140 pairs in each of most of the bands
    names = {r.whole: r.doc_id for r in marked.collect()}
    assert len({r.root for r in components(found).collect()}) == 1 and {names[r.node] for r in components(found).collect()} == set(range(120))
