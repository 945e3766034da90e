"""Chat, packing, decontamination, sharding and the pipeline."""

import json
import random
import zlib

import numpy as np
import pytest

import public_tokenizers
from linkloom.llm import chat, decontaminate, packing, registry, sharding
from tests.conftest import DATA, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).df()
    assert rows(got) == rows(want)


CALLS = "conv_id long, call_id string, position long, tool string, arguments string, uses array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"


def test_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "add", '{"y": 2, "x": 1.50}', []), (1, "b", 1, "add", '{"x": "1"}', ["d"]), (1, "c", 2, "add", '{"x":1,"y":2,"z":0}', ["b"]), (1, "d", 3, "add", "nope", ["a"]),
            (2, "p", 0, "add", '{"x":1,"y":1}', ["q"]), (2, "q", 1, "add", '{"x":1,"y":1}', ["p"]), (2, "r", 2, "gone", None, ["r", "zz"]), (2, "p", 5, "add", "{}", []), (None, "x", 0, "add", "{}", []), (3, None, 0, "add", "{}", None),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, "a", 1, 'say "hi"\n'), (1, "a", 9, "later"), (9, "a", 1, "lost")], RESULTS)
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True)], "tool string, argument string, type string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in chat.link_calls(calls, results, schemas).collect()}
    lost = got.pop((9, "a"))
    assert (lost.kind, lost.errors, lost.wave, lost.linked, lost.json) == ("result", ["call"], None, False, '{"id":"a","result":"lost"}')
    assert len(got) == 7 and all(r.kind == "call" for r in got.values())
    assert {k[1]: r.wave for k, r in got.items()} == {"a": 0, "b": 1, "c": 1, "d": 0, "p": None, "q": None, "r": None}
    assert got[1, "a"].linked and not got[1, "b"].linked
    assert got[1, "a"].json == '{"arguments":{"x":1.5,"y":2},"id":"a","name":"add","result":"say \\"hi\\"\\n","valid":true}'
    assert got[1, "b"].errors == ["missing:y", "type:x"] and got[1, "c"].errors == ["unknown:z"] and got[1, "d"].errors == ["json"]
    assert got[2, "r"].errors == ["tool", "use:r", "use:zz"] and got[2, "p"].position == 0
    for r in got.values():
        assert json.loads(r.json)["id"] == r.call_id
    place = {k: ((r.wave is None, r.wave or 0), r.position) for k, r in got.items() if k[0] == 1}
    assert place[1, "d"] < place[1, "b"] < place[1, "c"] and place[1, "a"] < place[1, "d"]
    assert chat.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def waves_by_force(uses):
    """uses: by call its place and those it uses. The wave of each, None in or behind a cycle."""
    known, seen = {}, set()

    def wave(c):
        if c in known:
            return known[c]
        if c in seen:
            return None
        seen.add(c)
        out = 0
        for u in uses[c][1]:
            if u in uses:
                w = wave(u)
                out = None if w is None or out is None else max(out, w + (uses[u][0] >= uses[c][0]))
        seen.discard(c)
        if out is not None or c not in seen:
            known[c] = out
        return out

    return {c: wave(c) for c in uses}


def test_waves_by_force(spark):
    rng = random.Random(8)
    convs = {k: {str(i): (i, [str(i + 1)] if i < 39 else []) for i in range(40)} for k in (0,)}  # a long chain backwards
    convs[1] = {str(i): (i, [str((i + 1) % 9)]) for i in range(9)} | {"x": (20, ["3"]), "y": (21, ["x", "z"]), "z": (22, [])}  # a cycle and what is behind it
    for k in range(2, 40):
        n = rng.randrange(1, 12)
        convs[k] = {str(i): (i, [str(rng.randrange(n + 1)) for _ in range(rng.choice([0, 0, 1, 1, 1, 2, 3]))]) for i in range(n)}
    rows_ = [(k, c, at, "t", "{}", u) for k, calls in convs.items() for c, (at, u) in calls.items()]
    schemas = spark.createDataFrame([("t", "x", "number", False)], "tool string, argument string, type string, required boolean")
    got = {(r.conv_id, r.call_id): r.wave for r in chat.link_calls(spark.createDataFrame(rows_, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    # a node on a cycle is None, found by reachability; others by the longest way
    for k, calls in convs.items():
        reach = {c: {u for u in us if u in calls} for c, (_, us) in calls.items()}
        for _ in calls:
            reach = {c: r | {x for u in r for x in reach[u]} for c, r in reach.items()}
        cyclic = {c for c in calls if c in reach[c]}
        bad = {c for c in calls if c in cyclic or reach[c] & cyclic}
        want = waves_by_force({c: v for c, v in calls.items() if c not in bad})
        for c in calls:
            assert got[k, c] == (None if c in bad else want[c]), (k, c)


def test_transcript_keeps_every_turn(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind", 0), (1, 1, "assistant", "early", 0), (1, 2, "user", "x " * 100000, 0), (1, 3, "assistant", None, 0), (1, 4, "user", None, 0), (1, 4, "user", None, 0), (2, 0, None, "who", 0), (None, 1, "user", "a", 0), (3, None, "user", "a", 0)],
        "conv_id long, turn long, role string, text string, wave int",
    )
    calls, results, rest = chat.transcript(turns)
    schemas = spark.createDataFrame(chat.REPLY, "tool string, argument string, type string, required boolean")
    got = {(r.conv_id, r.kind, r.position): r for r in chat.link_calls(calls, results, schemas).unionByName(rest).collect()}
    assert set(got) == {(1, "note", 0), (1, "result", 1), (1, "call", 2), (1, "call", 4), (2, "note", 0)}
    assert got[1, "call", 2].linked and json.loads(got[1, "call", 2].json)["arguments"]["words"] == 100000
    assert "missing:text" in got[1, "call", 4].errors and json.loads(got[2, "note", 0].json) == {"role": None, "text": "who"}


def test_codes_equal_the_tokenizer():
    from tokenizers import Tokenizer
    import pyarrow as pa

    rng = random.Random(1)
    signs = "abcXYZéÉ 'st\n.,!<|>0123ñ́×÷ß 日\t&"
    texts = ["", None, "it's 'tis", "x<|endoftext|>y", "3.14 km", "École ÉÉ naïve", "ΣΑΣ", "\x85y z", "a\x0bb\x0cc"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(500)]
    whole = Tokenizer.from_file(PATH)
    flat, at = packing.coder(PATH).encode(pa.array(texts), 1)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "x1", "ü"]) for _ in range(int(rng.paretovariate(0.7) * 20) % 6000))) for i in range(300)] + [(900, None), (901, ""), (None, "null id")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), PATH).toPandas()
    whole = Tokenizer.from_file(PATH)
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        own = (got[got.doc_id == i] if i is not None else got[got.doc_id.isna()]).sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in own.itertuples())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048
    size = got.groupby("sequence_id").length.sum()
    assert ((size & (size - 1)) != 0).sum() <= 3
    windows = got[got.offset == 0]
    groups = windows.groupby("step_group").tier.sum()
    assert sorted(groups.index) == list(range(-(-windows.tier.sum() // packing.STEP_TOKENS))) and groups.max() - groups.min() <= 2048
    for _, of in windows.groupby("tier"):
        n = of.groupby("step_group").size().reindex(groups.index, fill_value=0)
        assert n.max() - n.min() <= 1
    # a window of more than the smallest tier was opened by a piece of over half of it
    longest, whole_ = got.groupby("sequence_id").length.max(), got.groupby("sequence_id").length.sum()
    tier = got.groupby("sequence_id").tier.first()
    large = (tier > packing.TIERS[0]) & (whole_ == tier)
    assert large.any() and (2 * longest[large] > tier[large]).all()
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string"), PATH)
    assert twice.count() == 3 and twice.select("doc_tokens").distinct().count() == 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


DOCS = "doc_id long, text string, item_id long, share double"


def found(spark, docs, items, **k):
    frame = spark.createDataFrame([(i, t, 5, 0.5) for i, t in docs], DOCS)
    return {(r.doc_id, r.item_id): r for r in decontaminate.contamination(frame, spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, h int"), **k).collect()}


TRAIN = "If a train leaves with {} cars and travels {} km in {} hours then how fast does the train of {} go"


def test_reparameterised_questions(spark):
    item = TRAIN.format(3, 120, 3, "Maria")
    docs = [
        (1, "Intro words here. " + item + " and more"), (2, "so, " + TRAIN.format(7, 90, 7, "Bob").lower().replace("bob", "Bob").replace("km", "miles")), (3, TRAIN.format(7, 90, 8, "Bob")),
        (4, "a wholly different text about trains and hours that nobody asked for in this test"), (5, None), (6, ""), (None, item), (7, item.upper()), (8, item), (8, item), (9, "pad " * 60000 + item),
    ]
    got = found(spark, docs, [(10, item), (10, item), (11, None), (12, "short item only four"), (13, ""), (14, "Paris")])
    assert set(got) == {(1, 10), (2, 10), (3, 10), (7, 10), (8, 10), (9, 10)}
    assert got[1, 10].exact and got[1, 10].exact_item == 10 and not got[2, 10].exact and got[2, 10].share == 1
    assert got[3, 10].share < 1  # 3 became 7 and 8: the windows that say so least don't count
    assert found(spark, [], [(10, item)]) == {} and found(spark, docs, []) == {}


def test_short_items_and_openings(spark):
    items = [(1, "What is 15% of 240?"), (2, "Compute 12 + 34 * 56 - 78."), (3, "Tom has 5 apples. Tom gives 2 away. How many apples does Tom have?"), (4, "Paris")]
    docs = [
        (1, "A question: what is 15% of 240? Think."), (2, "Please compute 12 + 34 * 56 - 78. Thanks."), (3, "Maria has 7 apples. Maria gives 3 away. How many apples does Maria have?"),
        (4, "what is 16% of 250?"), (5, "In Paris it rains."), (6, "Paris"), (7, "Maria has 7 apples. Maria gives 3 away. How many apples does Bob have?"), (8, "Maria has many friends in town and gives them nothing at all today."),
    ]
    got = found(spark, docs, items)
    assert {(1, 1), (2, 2), (3, 3), (6, 4)} <= set(got) and not {(4, 1), (5, 4), (8, 3)} & set(got)
    assert not got[3, 3].exact and got[3, 3].share == 1


def test_partial_and_edited_passages(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" if i % 9 else str(rng.choice([48, 7])) for i in range(59)]
    edited = list(words)
    edited[next(i for i, w in enumerate(words) if w == "48")] = "49"
    part, short = words[10:35], words[10:25]
    other = [f"v{i}" for i in range(50)]
    docs = [(1, " ".join(other + part + other)), (2, " ".join(edited)), (3, " ".join(other + short + other)), (4, " ".join(other))]
    got = found(spark, docs, [(1, " ".join(words))])
    assert set(got) == {(1, 1), (2, 1)}
    assert got[1, 1].run == 25 and got[2, 1].n_found >= 52 - 8 and not got[2, 1].exact


def test_items_of_one_template_are_one_class(spark):
    items = [(i, TRAIN.format(i + 2, 100 + i, i + 2, "Maria")) for i in range(50)] + [(99, TRAIN.format(4, 7, 5, "Ann"))]
    docs = [(i, "Now: " + TRAIN.format(i + 2, 100 + i, i + 2, "Maria")) for i in range(60)]
    got = found(spark, docs, items)
    assert len(got) == 120 and {k[1] for k in got} == {0, 99}  # one row for each class, not for each item
    assert all(got[i, 0].exact_item == (i if i < 50 else None) for i in range(60))
    sizes = {r.item_id: r.least for r in decontaminate.classes(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sizes == {**dict.fromkeys(range(50), 0), 99: 99}


def test_recall_of_reparameterised_items(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    items, docs = [], []
    for i in range(60):
        names, numbers = rng.sample(["Ann", "Bob", "Cid", "Dora"], 2), [str(rng.randrange(100)) for _ in range(2)]
        body = [rng.choice(vocabulary) for _ in range(40)]
        for slot in (*names, *numbers) * 2:
            body.insert(rng.randrange(1, len(body)), slot)
        items.append((i, " ".join(body)))
        new = dict(zip((*names, *numbers), ("Eve", "Flo", "731", "902"), strict=True)) if len({*names, *numbers}) == 4 else {}
        docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(30)) + ". x " + " ".join(new.get(w, w) for w in body)))
        docs.append((1000 + i, " ".join(rng.choice(vocabulary) for _ in range(90))))
    got = found(spark, docs, items)
    assert sum((i, i) in got for i in range(60)) >= 57 and all(k[0] < 1000 and k[0] == k[1] for k in got)


def least_capacity(sizes, k):
    """By dynamic programming over all contiguous partitions."""
    inf = float("inf")
    best = [0] + [inf] * len(sizes)
    for _ in range(k):
        now = [0] + [inf] * len(sizes)
        for e in range(1, len(sizes) + 1):
            total = 0
            for s in range(e - 1, -1, -1):
                total += sizes[s]
                now[e] = min(now[e], max(best[s], total))
        best = [min(a, b) for a, b in zip(best, now, strict=True)]
    return best[-1]


@pytest.mark.parametrize("hot", [0, 60])
def test_shards(spark, hot):
    rng = random.Random(3)
    texts = [(i, "x" * int(rng.paretovariate(0.8) * 5) + str(i % 70)) for i in range(200)] + [(1000 + i, "the same") for i in range(hot)] + [(None, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0 AS shard")
    got = sharding.shard(docs, 4).toPandas()
    assert len(got) == len(texts)
    groups = got.groupby("text_hash")["size"].sum().sort_index()
    assert got.groupby("text_hash").shard.nunique().max() == 1
    assert got.groupby("shard")["size"].sum().max() == least_capacity(groups.tolist(), 4)
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_refined_ranges_find_the_same_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    rng = random.Random(4)
    groups = sorted((rng.getrandbits(64) - 2**63, rng.randrange(1, 1000)) for _ in range(150))
    last = sharding.boundaries(spark.createDataFrame(groups, "h long, size long"), 5)
    shard = [sum(h > x for x in last) for h, _ in groups]
    totals = [sum(s for (_, s), k in zip(groups, shard, strict=True) if k == i) for i in range(5)]
    assert max(totals) == least_capacity([s for _, s in groups], 5)


def test_shards_of_long_and_repeated_rows(spark):
    rows_ = [(1, "x" * 300_000), (1, "x" * 300_000), (2, "y"), (2, "y"), (None, "y"), (3, None), (4, "")]
    got = sharding.shard(spark.createDataFrame(rows_, "doc_id long, text string"), 3).toPandas()
    assert len(got) == 7 and sorted(got["size"])[-2:] == [300_001, 300_001] and got.groupby("text_hash").shard.nunique().max() == 1


def test_query_of_shards(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = sharding.op10_sharding(spark, DATA).toPandas()
    assert set(got.doc_id) == set(docs) and len(got) == len(docs) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert got.groupby("text_crc32").shard.nunique().max() == 1 and got.shard.between(0, 7).all()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    load = got.groupby("shard")["size"].sum()
    assert load.max() <= got["size"].sum() / 8 + got.groupby("text_crc32")["size"].sum().max()


def words_of(text):
    return (text or "").encode().split()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, DATA)
        assert left.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, DATA)
    assert 0 < packed.select("doc_id").distinct().count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    base = spark.read.parquet(f"{DATA}/documents.parquet")
    good = [r for r in base.where("lang = 'en' AND n_chars BETWEEN 400 AND 900").limit(40).collect()]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 150").first().text
    text = next(r.text for r in good)
    long = " ".join(f"{w}{i}" for i in range(30000) for w in ("alpha", "beta"))
    rows_ = [(10**6 + i, t, "en", "x", len(t or ""), i % 3 == 0, "k") for i, t in enumerate([None, "", text, text, text + " and so on", long, "Before it. " + item + " After it."])] + [(None, text, "en", "x", 1, True, "k"), (10**6 + 2, text, "en", "x", 1, True, "k")]
    docs = spark.createDataFrame(rows_, base.schema.simpleString()[7:-1].replace(":", " ") + ", kept boolean, kept_text string")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    quality_ = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert quality_.columns == docs.columns and not {10**6, 10**6 + 1} & {r.doc_id for r in quality_.collect()}
    near = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert [i for _, i in ids(near)] == [10**6, 10**6 + 2, 10**6 + 2, 10**6 + 5, 10**6 + 6, 0] and near.columns == docs.columns
    cut = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs, DATA).collect()}
    assert {10**6, 10**6 + 1, 10**6 + 5} <= set(cut) and cut[10**6].text is None and cut[10**6 + 5].text == long
    assert (10**6 + 3 in cut) == (len(words_of(text)) < 50)
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, DATA)
    assert 10**6 + 6 not in {r.doc_id for r in clean.collect()} and {10**6, None} <= {r.doc_id for r in clean.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
