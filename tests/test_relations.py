"""Hierarchies, anchors in use, links and sentences, tracking parameters: by hand and by force."""

import random

from pyspark.sql import functions as F

from linkloom.operators import anchors, hierarchy, positions, urls, words

TREE = "child int, parent int"


def closure_by_force(edges):
    out = {}
    for start in {p for _, p in edges}:
        seen, level, depth = set(), {start}, 0
        while level:
            depth += 1
            level = {c for c, p in edges if p in level and c != p} - seen - {start}
            seen |= level
            out |= {(start, c): depth for c in level}
    return out


def test_closure_by_force(spark):
    rng = random.Random(2)
    trees = [[(i, rng.randrange(i)) for i in range(1, 30)], [(i, i - 1) for i in range(1, 40)], [(rng.randrange(15), rng.randrange(15)) for _ in range(20)]]
    for edges in trees:
        got = {(r.ancestor, r.descendant): r.depth for r in hierarchy.closure(spark.createDataFrame(edges, TREE)).collect()}
        assert got == closure_by_force(set(edges))


def test_cycles_and_odd_rows(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (4, 3), (5, None), (6, 6)], TREE)
    pairs = hierarchy.closure(edges)
    got = {(r.ancestor, r.descendant) for r in pairs.collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b}
    assert {r.node for r in hierarchy.cyclic(edges, pairs).collect()} == {1, 2, 3}
    assert {r.id for r in hierarchy.with_descendants(spark.createDataFrame([(3,), (9,)], "id int"), pairs).collect()} == {1, 2, 3, 4, 9}
    assert hierarchy.closure(edges.limit(0)).count() == 0


def test_anchor_reuse_by_force(spark):
    rng = random.Random(4)
    words = ["Café", "cafe", "CAFÉ", "old mill", "Old Mill", "tea", None]
    rows = [(rng.randrange(25), rng.choice([*range(9), None]), rng.choice(words)) for _ in range(160)]
    fold = lambda a: a.lower().replace("é", "e")
    links = {(s, t, fold(a)) for s, t, a in rows if a is not None and t is not None}
    want = set()
    for s, t, k in links:
        others = {}
        for s2, t2, k2 in links:
            if k2 == k and s2 != s and t2 != t:
                others[t2] = others.get(t2, 0) + 1
        named = sorted(others.items(), key=lambda x: (-x[1], x[0]))[:5]
        want.add((s, t, k, sum(1 for s2, t2, k2 in links if (t2, k2) == (t, k) and s2 != s), len(others), tuple(named)))
    df = spark.createDataFrame(rows, "source int, target int, anchor string")
    got = anchors.reuse(df, anchors.surface(F.col("anchor"))).collect()
    assert {(r.source, r.target, fold(r.anchor), r.same, r.elsewhere, tuple((x.target, x.n) for x in r.named)) for r in got} == want and len(got) == len(want)
    assert anchors.reuse(df.limit(0), anchors.surface(F.col("anchor"))).count() == 0


def test_links_touch_sentences(spark):
    text = "One here. Two there! Three."
    at = lambda w: (text.index(w), text.index(w) + len(w))
    cases = [[at("here")], [at("here. Two")], [(9, 10)], [(0, 0)], [], [at("Three."), (100, 120)]]
    rows = [(i, None, text, [{"s": s, "e": e} for s, e in spans]) for i, spans in enumerate(cases)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string, links array<struct<s:int,e:int>>")
    got = positions.touched(df, F.col("links")).orderBy("doc_id", "sentence").collect()
    want = [[True, False, False], [True, True, False], [False] * 3, [False] * 3, [False] * 3, [False, False, True]]
    assert [[r.touched for r in got if r.doc_id == i] for i in range(len(cases))] == want


def test_tracking_parameters(spark):
    df = spark.createDataFrame([("/a?UTM_Source=1&b=2",), ("/a?mc_foo=1&mc_CID=2",), ("/a?Gclid=1",)], "h string")
    assert [r.x for r in df.select(urls.normal(F.col("h"), F.lit("x.org")).alias("x")).collect()] == ["x.org/a?b=2", "x.org/a?mc_foo=1", "x.org/a"]


def test_pages_that_are_no_content(spark):
    yes = ["/my-account", "/shop/conditions/", "/register", "/aviso-legal", "https://x.org/our-privacy-policy?x=1", "/cookie"]
    no = ["/registered", "/legal/news", "/cartoon", "/", "/a-contactor"]
    df = spark.createDataFrame([(u,) for u in yes + no], "u string")
    assert [r.x for r in df.select(words.non_content(F.col("u")).alias("x")).collect()] == [True] * len(yes) + [False] * len(no)


def test_signals_of_candidates(spark):
    from linkloom.operators import suggest

    df = spark.createDataFrame
    pairs = df([(1, 2), (1, 3), (2, 3), (2, 4), (3, None)], "src long, dst long")
    got = suggest.with_signals(
        pairs, df([(2, 5), (9, 1)], "id long, inbound long"), df([(3, 400), (None, 1)], "id long, age_days int"), df([(2, 3), (2, 3), (None, 4)], "source long, target long"),
        df([(3,)], "target long"), df([(4,)], "id long"),
    )
    cells = sorted(((r.src, r.dst, r.inbound, r.age_days, r.penalized, r.pillar) for r in got.collect()), key=str)
    assert cells == [(1, 2, 5, None, False, False), (1, 3, 0, 400, True, False), (2, 4, 0, None, False, True), (3, None, 0, None, False, False)]


def test_ages_count_from_the_last_change(spark):
    from datetime import datetime

    from linkloom.operators import history

    log = spark.createDataFrame([(1, datetime(2024, 1, 1, 12)), (1, datetime(2024, 1, 5)), (2, datetime(2024, 1, 1, 12)), (3, None)], "article long, at timestamp")
    assert sorted(map(tuple, history.ages(log).collect())) == [(1, 0), (2, 3), (3, None)]
    assert history.ages(log.limit(0)).count() == 0


def test_listing_shows_what_the_reader_may_edit(spark):
    from datetime import datetime, timedelta

    from linkloom.operators import history

    at = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [(i, a, at(t), i % 2 == 0) for i, (a, t) in enumerate([(1, 1), (1, 2), (1, 3), (2, 3), (3, 0), (None, 9), (4, 2)])]
    log = spark.createDataFrame(rows, "id long, article long, at timestamp, undone boolean")
    titles, mine = spark.createDataFrame([(1, "one"), (3, "three")], "article long, title string"), spark.createDataFrame([(1,), (3,), (1,)], "article long")
    got = lambda **kw: sorted((r.article, r.title, r.total, r.active, r.undone, r.place, r.id) for r in history.listing(log, titles, mine, first=2, **kw).collect())
    one, three = [(1, "one", 3, 1, 2, 1, 2), (1, "one", 3, 1, 2, 2, 1)], [(3, "three", 1, 0, 1, 1, 4)]
    assert got() == one + three
    assert got(size=2) == one  # articles 2 and 1 make the page, 2 isn't shown
    assert got(size=2, page=2) == three
    assert got(size=2, others=True) == one + [(2, None, 1, 1, 0, 1, 3)]


def test_ledger_clamps(spark):
    from decimal import Decimal

    from linkloom.operators import history

    calls = spark.createDataFrame([(1, "t" * 40, "done", -3, -0.5, "p" * 90, "m", ""), (2, "t", "open", 7, 0.1234565, "p", "m" * 81, "e"), (3, None, None, None, None, None, None, None)], "id long, type string, status string, tokens long, cost double, provider string, model string, error string")
    got = {r.id: tuple(r)[1:] for r in history.ledger(calls).collect()}
    assert got[1] == ("t" * 30, "done", 0, Decimal("0.000000"), "p" * 80, "m", None)
    assert got[2][:3] == ("t", "failed", 7) and got[2][5:] == ("m" * 80, "e")
    assert got[3] == (None, "failed", 0, Decimal("0.000000"), None, None, None)
