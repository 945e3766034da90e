"""Tables written by buckets and read by versions: what a write leaves, also when it ends half-way."""

import os

import pytest

from linkloom.sources import versions

SCHEMA = "doc_id long, term string, weight long"


def rows(spark, path):
    return sorted(map(tuple, versions.load(spark, path, SCHEMA).collect()))


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def put(spark, path, new, gone=(), **kw):
    frame = spark.createDataFrame([*new], SCHEMA)
    out = spark.createDataFrame([(i,) for i in gone], "doc_id long")
    return versions.replace(spark, path, "doc_id", out, frame, SCHEMA, **kw)


def test_writes_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rows(spark, path) == []
    put(spark, path, [(i, f"t{i}", i) for i in range(200)])
    assert len(rows(spark, path)) == 200
    before, pointer = files(path), versions.current(spark, path)
    made = put(spark, path, [(7, "new", 1), (7, "newer", 2), (500, "x", 3)], gone=[7, 8])
    assert rows(spark, path) == sorted([(i, f"t{i}", i) for i in range(200) if i not in (7, 8)] + [(7, "new", 1), (7, "newer", 2), (500, "x", 3)])
    assert before <= files(path) and len(made) <= 3
    assert all(versions.current(spark, path)[b] == v for b, v in pointer.items() if b not in made)


def test_a_write_that_ends_before_the_pointer_moves_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, "a", 1), (2, "b", 2)])

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        put(spark, path, [(1, "z", 9)], gone=[1], before_publish=killed)
    assert rows(spark, path) == [(1, "a", 1), (2, "b", 2)]
    put(spark, path, [(1, "z", 9)], gone=[1])
    assert rows(spark, path) == [(1, "z", 9), (2, "b", 2)]


def test_empty_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, "a", 1), (1, "a", 1), (None, "n", 0)])
    put(spark, path, [])
    assert versions.load(spark, path, SCHEMA).count() == 3
    put(spark, path, [], gone=[1])
    assert [r.term for r in versions.load(spark, path, SCHEMA).collect()] == ["n"]
