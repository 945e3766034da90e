"""Streams whose state ends: retention by timers, rate limits whose windows close, document frequencies with retractions, notices once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkloom.functions.text import tokens
from linkloom.operators import words

_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_NO_EMPTY = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


@contextmanager
def setting(spark: SparkSession, *pairs: tuple[str, str]) -> Iterator[None]:
    """Settings of a query are those of the moment it starts."""
    before = [(k, spark.conf.get(k, None)) for k, _ in pairs]
    for k, v in pairs:
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before:
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(stream: DataFrame, where: str, timers: bool = True) -> DataFrame:
    """All that an append stream gives for what is there now, after what it gave before from this folder (`where`).

    Each micro-batch writes a folder of its own, so that one that runs again after a failure writes the same one. timers:
    whether a last micro-batch without data moves the clock; state by processing time would ask for such ones without end.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/{number:06d}")

    spark = stream.sparkSession
    with setting(spark, _ROCKS, *([] if timers else [_NO_EMPTY])):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{where}/out")


class _Group(StatefulProcessor):
    """The last change of a group, and a timer a millisecond after it: the clock is `days` behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(r["ms"].max()) for r in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + 1)
            self.last.update((newest,))
            self.handle.registerTimer(newest + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"batch": [key[0]]})

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.groupby("batch", as_index=False)["at"].max()


def expired_groups(changes: DataFrame, days: int) -> DataFrame:
    """batch: groups of a stream of changes (batch, at) whose last change was more than `days` before the stream's newest one.

    A group is one row of state, the time of its last change, with a timer that each newer change puts off. What a task reads is
    reduced to a row for each group of an Arrow batch before it crosses the network, so that a hot group is no hot task.
    Changes that are `days` or more behind the newest of earlier micro-batches are left out: groups of such changes alone
    are named by nobody. A change to a group that has ended begins it anew. Rows without a group or a time have no say.
    """
    slim = changes.where("batch IS NOT NULL AND at IS NOT NULL").select(F.col("batch").cast("string").alias("batch"), F.col("at").cast("timestamp").alias("at"))
    partial = slim.mapInPandas(_newest, "batch string, at timestamp").withColumn("ms", F.unix_millis("at")).withWatermark("at", f"{days} days")
    return partial.groupBy("batch").transformWithStateInPandas(_Group(), "batch string", "append", "eventTime")


class _Windows(StatefulProcessor):
    """A window that is open: when it began and how many calls it holds; a timer ends it."""

    def __init__(self, seconds: int, most: int) -> None:
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "began long, held long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held = self.window.get() if self.window.exists() else (None, 0)
        began = first
        calls = pd.concat([r[["at_s", "id"]] for r in rows]).sort_values(["at_s", "id"])
        over = []
        for at, ident in zip(calls["at_s"].to_numpy(), calls["id"].to_numpy(), strict=True):
            if began is None or at >= began + self.seconds:
                began, held = int(at), 0
            held += 1
            if held > self.most:
                over.append(ident)
        self.window.update((began, held))
        if began != first:
            if first is not None:
                self.handle.deleteTimer((first + self.seconds) * 1000)
            self.handle.registerTimer((began + self.seconds) * 1000)
        yield pd.DataFrame({"id": pd.Series(over, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(calls: DataFrame, seconds: int = 60, most: int = 10, late: str = "1 minute") -> DataFrame:
    """id: calls (id, who, at) of a stream beyond `most` in a window of seconds that begins with a call when none is open.

    State of a `who` is one window, which a timer takes away when the stream's clock (its newest call less `late`) has passed
    its end: who doesn't call costs nothing. A micro-batch's calls of one `who` are taken in their order, 16 bytes a
    call; calls later than the clock of earlier micro-batches are left out. Calls without a `who` or a time are not limited.
    """
    known = calls.where("who IS NOT NULL AND at IS NOT NULL").select("who", "id", F.col("at").cast("timestamp").alias("at")).withColumn("at_s", F.unix_seconds("at"))
    return known.withWatermark("at", late).groupBy("who").transformWithStateInPandas(_Windows(seconds, most), "id long", "append", "eventTime")


class _Terms(StatefulProcessor):
    """What a document counts for now, and, for `remember` after its deletion, the number of the change that deleted it."""

    def __init__(self, remember_ms: int) -> None:
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq long, lang string, terms array<string>")
        self.gone = handle.getValueState("gone", "seq long", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, lang, terms = self.held.get() if self.held.exists() else (None, None, [])
        if seq is None and self.gone.exists():
            seq = self.gone.get()[0]
        newest = max((r for b in rows for r in b[["seq", "lang", "terms"]].itertuples(index=False)), key=lambda r: r.seq)
        if seq is not None and newest.seq <= seq:
            return
        before = {(lang, t) for t in terms}
        after = set() if newest.terms is None else {(newest.lang, t) for t in newest.terms}
        if newest.terms is None:
            self.held.clear()
            self.gone.update((int(newest.seq),))
        else:
            self.held.update((int(newest.seq), newest.lang, list(newest.terms)))
            self.gone.clear()
        turns = [(*x, 1) for x in after - before] + [(*x, -1) for x in before - after]
        yield pd.DataFrame(turns, columns=["lang", "term", "delta"]).astype({"delta": "int64"})

    def close(self) -> None:
        pass


def frequency_changes(feed: DataFrame, remember_days: int = 30) -> DataFrame:
    """lang, term, delta: what a stream of changes to documents (doc_id, seq, lang, text) adds to and takes from document frequencies.

    seq orders the changes of a document; a null text is a deletion. Words are found before the shuffle; a task holds one
    document's distinct words at a time. A change that is not newer than the document's last one counts for nothing, so
    repeated and overtaken changes do no harm; of a deleted document this is remembered for `remember_days`, then its state is gone.
    """
    words_of = F.when(F.col("text").isNotNull(), F.array_distinct(tokens(F.col("text")))).alias("terms")
    return feed.where("doc_id IS NOT NULL").select("doc_id", "seq", "lang", words_of).groupBy("doc_id").transformWithStateInPandas(_Terms(remember_days * 86_400_000), "lang string, term string, delta long", "append", "processingTime")


def frequencies(deltas: DataFrame) -> DataFrame:
    """lang, term, df: the sum of all changes; words of no document are no rows."""
    return deltas.groupBy("lang", "term").agg(F.sum("delta").alias("df")).where("df > 0")


def notices_once(notices: DataFrame, late: str = "1 hour") -> DataFrame:
    """request, article: a stream of notices (request, article, at), each pair once, as soon as its first notice is there.

    A pair is remembered until the clock (the newest notice less `late`) has passed its first notice by `late`: the notices of one
    request must lie within that. Notices older than the clock are left out: the nightly pass finds what they were about.
    """
    return notices.withWatermark("at", late).dropDuplicatesWithinWatermark(["request", "article"]).select("request", "article")


def stream_lost_links(saved: DataFrame, log: DataFrame, where: str) -> DataFrame:
    """id: logged links (id, article, pair) that saved articles (a stream of article, html) no longer hold.

    Each micro-batch is joined with the log as it is at that time; an article that is saved twice in one is its own last
    version's business, so its html must be one row. Ids come once however often an article is saved.
    """

    def put(batch: DataFrame, number: int) -> None:
        words.lost_links(log, batch).write.mode("overwrite").parquet(f"{where}/out/{number:06d}")

    query = saved.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return saved.sparkSession.read.schema(log.select("id").schema).option("recursiveFileLookup", "true").parquet(f"{where}/out").distinct()
