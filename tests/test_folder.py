"""Saved pages as a data source, and links as a table function."""

import pytest

from linkloom.sources import folder
from linkloom.sources.html import blocks
from linkloom.sources.tables import read
from pyspark.sql import functions as F
from tests.conftest import DATA, rows


@pytest.fixture
def saved(spark, tmp_path):
    spark.dataSource.register(folder.PageFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for i in range(12):
        at = tmp_path / f"d{i % 3}"
        at.mkdir(exist_ok=True)
        (at / f"p{i}.html").write_text("<p>é <a href='/x'>x</a></p>" * i, encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no page")
    (tmp_path / "odd.HTM").write_bytes(b"\xff<p>a")
    return tmp_path


def test_pages_of_a_folder(spark, saved):
    load = lambda **o: spark.read.format("page_folder").options(**o).load(str(saved))
    got = {r.path: r for r in load().collect()}
    assert len(got) == 13 and got["d0/p3.html"].html == "<p>é <a href='/x'>x</a></p>" * 3 and got["d0/p0.html"].html == "" and got["odd.HTM"].html == "�<p>a"
    assert all(r.size == len(r.html.encode()) for p, r in got.items() if p != "odd.HTM")
    assert load(partition_bytes=100).rdd.getNumPartitions() > load().rdd.getNumPartitions() == 1


def test_filters_choose_files(spark, saved):
    pages = spark.read.format("page_folder").load(f"file:{saved}")
    (saved / "d1" / "p1.html").unlink()  # it is gone when rows are read, and isn't opened
    assert {r.path for r in pages.where("path LIKE 'd2/%' AND size > 100").collect()} == {"d2/p5.html", "d2/p8.html", "d2/p11.html"}
    assert [r.path for r in pages.where("path = 'd0/p3.html'").collect()] == ["d0/p3.html"]
    assert pages.where("path = 'd0/p3.html' AND html LIKE '%nothing%'").count() == 0


def test_links_are_those_of_the_blocks(spark):
    pages = read(spark, DATA, "pages")
    want = blocks(pages).select("page_id", "block", F.explode("links").alias("l")).select("page_id", "block", "l.href", "l.anchor")
    got = folder.links(pages)
    assert rows(got.toPandas()) == rows(want.toPandas()) and got.count() > 50
    assert folder.links(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).count() == 0
