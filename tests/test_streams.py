"""Streams with state that ends, over several micro-batches and a restart between, against the same work on tables."""

from datetime import datetime, timedelta

from linkloom.functions.text import tokens
from linkloom.streaming import stateful
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_groups_end_as_a_whole(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id long, batch string, at timestamp"
    day = lambda n: START + timedelta(days=n)
    parts = [
        [(1, "a", day(0)), (2, "b", day(1)), (3, None, day(1))],
        [(4, "a", day(5)), (5, "c", day(6))],  # puts a's end off
        [(6, "d", day(12)), (7, "e", None)],  # ends b, and c not: six days
    ]
    for i, rows in enumerate(parts):
        put(spark, path, rows, schema)
        got = stateful.run(stateful.expired_groups(source(spark, path, schema), 7), str(tmp_path / "q"))  # each time a new query over the old state
        assert sorted(r.batch for r in got.collect()) == [[], [], ["b"]][i]
    put(spark, path, [(8, "f", day(12) + timedelta(milliseconds=1))], schema)
    assert sorted(r.batch for r in stateful.run(stateful.expired_groups(source(spark, path, schema), 7), str(tmp_path / "q")).collect()) == ["a", "b"]  # a: more than seven days by a millisecond


def test_rate_windows_close(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id long, who string, at timestamp"
    times = [0, 1, 2, 3, 59, 60, 61, 62, 63, 200, 201, 202, 203, 203]
    calls = [(i, w, START + timedelta(seconds=t)) for i, (t, w) in enumerate((t, w) for t in times for w in "xy" if (t, w) != (3, "y"))]
    want, open_ = [], {}
    for i, w, at in calls:
        began, held = open_.get(w, (None, 0))
        if began is None or (at - began).total_seconds() >= 60:
            began, held = at, 0
        open_[w] = (began, held + 1)
        want += [i] if held + 1 > 3 else []
    for a in range(0, len(calls), 6):
        put(spark, path, calls[a : a + 6], schema)
        got = stateful.run(stateful.rate_limited(source(spark, path, schema), 60, 3), str(tmp_path / "q"))
    assert sorted(r.id for r in got.collect()) == want and want


def test_changes_to_documents_take_back_what_they_counted(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "doc_id long, seq long, lang string, text string"
    parts = [
        [(1, 1, "en", "a b b"), (2, 1, "en", "b c"), (3, 1, "es", ""), (None, 1, "en", "zz")],
        [(1, 2, "en", "a d"), (2, 2, "en", None), (1, 2, "en", "a d")],
        [(2, 1, "en", "late"), (3, 2, "en", "c"), (4, 5, "en", "x"), (4, 6, "en", "y")],
        [(4, 5, "en", "x"), (2, 3, "es", "b"), (3, 3, "en", None), (9, 1, "en", None)],
    ]
    seen: dict = {}
    for rows in parts:
        put(spark, path, rows, schema)
        got = stateful.run(stateful.frequency_changes(source(spark, path, schema)), str(tmp_path / "q"), timers=False)
        for d, seq, lang, text in rows:
            if d is not None and seq > seen.get(d, (0,))[0]:
                seen[d] = (seq, lang, text)
        now = spark.createDataFrame([(d, x[1], x[2]) for d, x in seen.items()], "doc_id long, lang string, text string")
        want = now.where("text IS NOT NULL").select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("lang", "term").count()
        assert sorted(map(tuple, stateful.frequencies(got).collect())) == sorted(map(tuple, want.collect()))


def test_notices_come_once(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "request long, article long, at timestamp"
    at = lambda m: START + timedelta(minutes=m)
    parts = [[(1, 7, at(0)), (1, 7, at(1)), (1, 8, at(2))], [(1, 7, at(30)), (2, 7, at(200))], [(3, 9, at(10)), (2, 7, at(210)), (4, 7, at(220))]]
    for rows in parts:
        put(spark, path, rows, schema)
        got = stateful.run(stateful.notices_once(source(spark, path, schema)), str(tmp_path / "q"))
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (2, 7), (4, 7)]  # (3, 9) came too late


def test_lost_links_by_saves(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "article long, html string"
    log = spark.createDataFrame([(1, 7, "/a\x1fx"), (2, 7, "/b\x1fy"), (3, 8, "/a\x1fx"), (4, 9, "/a\x1fx")], "id long, article long, pair string")
    for rows, want in ([(7, '<a href="/a">x</a>')], [2]), ([(7, None), (8, '<a href="/a">x</a>')], [1, 2]):
        put(spark, path, rows, schema)
        got = stateful.stream_lost_links(source(spark, path, schema), log, str(tmp_path / "q"))
        assert sorted(r.id for r in got.collect()) == want
