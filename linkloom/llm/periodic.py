"""Periodic runs of words: stretches that repeat their first words at least four times.

Candidates lie on a harmonic grid: a run of period q and 4 q words or more holds four neighbouring multiples of q, whose
words are equal, so the multiples of each q are looked at, n log n places in all. How far a candidate's period reaches to
both sides is asked of a grammar of the texts that hold one. The grammar is made by recompression: blocks of equal symbols
become one symbol, then pairs of a symbol of one class and one of another, in turn, until a text is one symbol. Equal
stretches are parsed equally but for their ends, so that two places are compared by walking up while both begin a symbol and
down again where symbols differ: a logarithmic number of steps, taken for all candidates of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SPACE, spread, table, without
from .words import chunks, column

#: A run has so many words at least, and so many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
BATCH_BYTES = 1 << 20
#: Comparisons made in one go, but for one of each stretch.
AT_ONCE = 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Grammar:
    """The levels of a sequence's recompression.

    symbols[h]: the sequence at level h. first[h]: where each symbol of level h + 1 begins at level h, and the end; parent[h]:
    the other way round. block[h]: whether level h + 1 is made of blocks, or else of pairs. ends: which symbols stay as they
    are. They must be unique, and stand at both ends of the sequence and between texts, so that no comparison runs past one.
    """

    def __init__(self, sequence: np.ndarray, ends: np.ndarray):
        self.symbols, self.first, self.parent, self.block = [sequence], [], [], []
        while (~ends[1:] & ~ends[:-1]).any():
            s = self.symbols[-1]
            begins = np.concatenate(([True], s[1:] != s[:-1]))
            if begins.all():
                begins, key = self._pairs(s, ends)
                self.block.append(False)
            else:
                at = np.flatnonzero(begins)
                size = np.diff(at, append=len(s))
                key = s[at] * (size.max() + 1) + size
                self.block.append(True)
            at = np.flatnonzero(begins)
            self.first.append(np.append(at, len(s)))
            self.parent.append(np.cumsum(begins) - 1)
            self.symbols.append(np.unique(key, return_inverse=True)[1])
            ends = ends[at]

    @staticmethod
    def _pairs(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where symbols of the next level begin, and what tells them apart. Neighbours differ; a symbol's class is a hash of it, tried until some pair has two."""
        inner, seed = ~ends, 0
        while True:
            h = (s.astype(np.uint64) + np.uint64((seed + 1) * _ODD[0] % 2**64)) * np.uint64(_ODD[1])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[2])
            low = (h >> np.uint64(63)).astype(bool)
            both = inner[:-1] & inner[1:]
            ahead, behind = both & low[:-1] & ~low[1:], both & ~low[:-1] & low[1:]
            paired = ahead if ahead.sum() >= behind.sum() else behind
            if paired.any():
                break
            seed += 1
        begins = np.concatenate(([True], ~paired))
        right = np.zeros(len(s), s.dtype)
        right[:-1][paired] = s[1:][paired] + 1
        return begins, (s * (s.max() + 2) + right)[begins]

    def reach(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """How many symbols from i and from j on are equal, onwards (way 1) or backwards (way -1). i and j differ."""
        p, q = i.copy(), j.copy()
        left = np.zeros(len(p), np.int64)  # the level at which each comparison turned
        at, top = np.arange(len(p)), len(self.first)
        for h in range(top):
            s, first, parent = self.symbols[h], self.first[h], self.parent[h]

            def rest(x: np.ndarray, first=first, parent=parent) -> np.ndarray:
                up = parent[x]
                return first[up + 1] - x if way > 0 else x - first[up] + 1

            def fresh(x: np.ndarray, first=first, parent=parent) -> np.ndarray:
                up = parent[x]
                return first[up] == x if way > 0 else first[up + 1] - 1 == x

            same = s[p[at]] == s[q[at]]
            left[at[~same]] = h
            at = at[same]
            within = at[~(fresh(p[at]) & fresh(q[at]))]
            step = np.minimum(rest(p[within]), rest(q[within]))
            p[within] += way * step
            q[within] += way * step
            other = within[s[p[within]] != s[q[within]]]
            left[other] = h
            at = np.setdiff1d(at, other, assume_unique=True)
            p[at], q[at] = parent[p[at]], parent[q[at]]
            if not len(at):
                break
        same = at[self.symbols[top][p[at]] == self.symbols[top][q[at]]]  # two texts that are equal as a whole
        left[at] = top
        p[same] += way
        q[same] += way
        for h in range(top - 1, -1, -1):
            at = np.flatnonzero(left > h)
            s, first = self.symbols[h], self.first[h]
            a, b = p[at], q[at]
            size = np.minimum(first[a + 1] - first[a], first[b + 1] - first[b]) if self.block[h] else 1
            a, b = (first[a], first[b]) if way > 0 else (first[a + 1] - 1, first[b + 1] - 1)
            step = way * np.where(s[a] == s[b], size, 0)
            p[at], q[at] = a + step, b + step
        return np.abs(p - i)


def candidates(sequence: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, last, period: of stretches of multiples of a period, four at least, with the same word, their first and last but one. longest: words of the longest text."""
    found = []
    for q in range(1, longest // MIN_EXPONENT + 1):
        grid = sequence[::q]
        same = np.concatenate(([False], grid[1:] == grid[:-1], [False]))
        if np.count_nonzero(same) < 3:
            continue
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= MIN_EXPONENT - 1
        if long.any():
            found.append(np.stack([begin[long] * q, (end[long] - 1) * q, np.full(long.sum(), q)]))
    out = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return out[0], out[1], out[2]


def runs(sequence: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of every run, by start, then period. sequence and ends: see Grammar."""
    at, last, q = candidates(sequence, longest)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    grammar, found, most = Grammar(sequence, ends), [], 1
    last = last - (MIN_EXPONENT - 2) * q  # the last multiple that can be a run's first
    while len(at):
        # the next multiples of each stretch, twice as many each time: one is enough if it is of a run that holds all
        n = np.minimum((last - at) // q + 1, most)
        first = np.cumsum(n) - n
        period = np.repeat(q, n)
        i = np.repeat(at, n) + (np.arange(n.sum()) - np.repeat(first, n)) * period
        ahead = grammar.reach(i, i + period, 1)
        start, end = i - grammar.reach(i - 1, i + period - 1, -1), i + period + ahead
        fits = end - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
        found.append(np.stack([start, end, period], axis=1)[fits])
        at = np.maximum.reduceat(i + (ahead // period + 1) * period, first)  # the first multiple that isn't of these runs
        rest = at <= last
        at, last, q = at[rest], last[rest], q[rest]
        most = min(2 * most, max(1, AT_ONCE // max(len(at), 1)))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    least = np.ones(len(every), bool)  # a stretch has its multiples as periods, too
    least[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[least]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words in one sequence, a symbol of its own before, between and after them: the sequence, which are such symbols, where texts begin."""
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size + 1) - size
    ends = np.zeros(size.sum() + len(texts) + 1, bool)
    ends[np.append(begin - 1, len(ends) - 1)] = True
    sequence = np.empty(len(ends), np.int64)
    sequence[~ends] = np.concatenate(texts) if texts else []
    sequence[ends] = sequence[~ends].max(initial=0) + 1 + np.arange(len(texts) + 1)
    return sequence, ends, begin


def _find(words: list[list[bytes]]) -> list[np.ndarray]:
    """(start, length, period) of the runs of each text. Only texts with a candidate come into a grammar."""
    flat = pa.array([w for text in words for w in text], pa.large_binary()).dictionary_encode()
    ids = flat.indices.to_numpy().astype(np.int64)
    bounds = np.cumsum([0, *(len(t) for t in words)])
    texts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(words)
    sequence, _, begin = _joined(texts)
    at, last, q = candidates(sequence, max(map(len, texts), default=0))
    own = np.searchsorted(begin, at, "right") - 1
    # four multiples in one text: stretches that run on into others are told apart below
    held = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(own, np.searchsorted(begin, last + q, "right") - 1, strict=True)])) if len(at) else []
    if len(held):
        sequence, ends, begin = _joined([texts[i] for i in held])
        found = runs(sequence, ends, max(len(texts[i]) for i in held))
        of = np.searchsorted(begin, found[:, 0], "right") - 1
        for k, i in enumerate(held):
            own = found[of == k] if len(found) else none
            out[i] = np.stack([own[:, 0] - begin[k], own[:, 1] - own[:, 0], own[:, 2]], axis=1) if len(own) else none
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", BATCH_BYTES):
        words = [(t or b"").split() for t in column(batch, "text").cast(pa.large_binary()).to_pylist()]  # bytes split at ASCII white space
        kept, rows = [], []
        for text, own in zip(words, _find(words), strict=True):
            if len(own):
                stays = np.zeros(len(text) + 1, np.int64)
                np.add.at(stays, own[:, 0] + own[:, 2], 1)
                np.add.at(stays, own[:, 0] + own[:, 1], -1)
                text = [text[i] for i in np.flatnonzero(np.cumsum(stays[:-1]) == 0)]
            kept.append(b" ".join(text))
            rows.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([len(t) for t in words], pa.int64()), pa.array(rows, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
            [*batch.schema.names, "n_words", "runs", "collapsed"],
        )


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (start, length, period: by start, then period) and collapsed: the text with each run cut to its first period.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of at least max(6, 4 q) words with
    the smallest period q that its neighbours don't continue. Left words are joined by one space. A null or empty text
    has no words, no runs and an empty collapsed text. Texts of any length are searched whole, each row by itself, so rows
    that repeat get equal answers and an empty table gives none. Other columns stay as they are, whatever their names; those named
    n_words, runs or collapsed are replaced. A text takes about 150 bytes of memory a word if it holds a candidate.
    """
    docs = without(docs, "n_words", "runs", "collapsed")
    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.mapInArrow(_collapse, f"{schema}n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs whose text repeats from a place on where crc32 of the doc_id in decimals is divisible by ten, as the contract of op11 says.

    With h that checksum and g = h div 10, word i >= a of n becomes word a + (i - a) % p: a = g % n, p = 1 + (n - a) div (3 + g % 8).
    Texts without words and rows without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPACE.replace("[", "[^")), F.lit(0))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    # the words are bound by a lambda, so that they are taken out once
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))[0]
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, some made to repeat, as digests, with the run of the greatest length by period."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    found = collapse_runs(planted(docs)).select("doc_id", "n_words", "runs", "collapsed")
    # greater length / period first, by whole numbers; then the smaller start, then the smaller period
    ahead = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise((a["period"] - b["period"]).cast("int"))
    best = found.withColumn("best", F.get(F.array_sort("runs", ahead), 0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
