"""Toxicity as severity: cumulative-link ordinal regression over sparse text features.

Features are words, their first three to six bytes and the 5-grams of bytes inside them. Spark counts them over a bounded sample of
labelled rows and keeps the VOCABULARY features that tell toxic rows best (log-likelihood ratio); the
sample's sparse rows, a bounded number of a bounded width, are what the driver fits. P(grade > k) is
logistic(weights . x - threshold k): one set of weights, ordered thresholds. Scoring looks n-grams up
in a bitmap and adds up the few that are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table, without
from .words import Words, chunks, column, mix, signed

SAMPLE_ROWS, VOCABULARY, MIN_ROWS, GRAM, PREFIXES = 20_000, 512, 3, 5, (3, 4, 5, 6)
#: The least G statistic of a feature: 30 is p = 4e-8, as rows hold millions of features by chance.
MIN_G = 30.0
RIDGE, STEPS, RATE = 1e-4, 400, 0.1
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def features(texts: pa.Array) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and per kind of feature its 64-bit codes and the words that hold them."""
    w = Words(texts, lower=True, word_bytes=_WORD)
    out = [(w.hashes(), np.arange(len(w)))]
    for n in PREFIXES:
        word = np.flatnonzero(w.end - w.start > n)
        out.append((w.prefixes(n)[word], word))
    data = w.bytes.astype(np.uint64)
    if len(data) >= GRAM and len(w):
        code = np.zeros(len(data) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            code = code << np.uint64(8) | data[i : len(code) + i]
        word = np.searchsorted(w.start, np.arange(len(code)), "right") - 1
        ok = np.flatnonzero((word >= 0) & (np.arange(GRAM, len(data) + 1) <= w.end[word]))
        out.append((mix(code[ok] + np.uint64(1 << 40)), word[ok]))
    return w, out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature, over a megabyte of text: the rows that hold it, and how many of them are toxic."""
    for batch in chunks(batches, "text"):
        w, kinds = features(column(batch, "text"))
        row, toxic = w.row(), np.asarray(column(batch, "y")) > 0
        for code, word in kinds:
            order = np.lexsort((row[word], code))
            h, r = code[order], row[word][order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))[: len(h)]
            h, r = h[once], r[once]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
            if len(h):
                yield pa.RecordBatch.from_arrays([signed(h[first]), np.diff(np.append(first, len(h))), np.add.reduceat(toxic[r].astype(np.int64), first)], ["f", "n", "t"])


class Lookup:
    """Known features: a bitmap first, then their sorted codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes.astype(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known codes, and their numbers."""
        if not len(self.codes):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.flatnonzero(self.bits[(code >> np.uint64(44)).astype(np.int64)])
        n = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        ok = self.codes[n] == code[at]
        return at[ok], n[ok]

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: row, feature and value of each entry."""
        w, kinds = features(texts)
        row, n = w.row(), len(self.codes)
        cells = []
        for code, word in kinds:
            at, number = self.find(code)
            cells.append(row[word[at]] * max(n, 1) + number)
        cell, count = np.unique(np.concatenate(cells), return_counts=True)
        return cell // max(n, 1), cell % max(n, 1), np.log1p(count)


def _sparse(lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, number, value = lookup.value.rows(column(batch, "text"))
            bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (number.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), *lists], ["doc_id", "y", "f", "v"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Ordinal:
    """P(grade > k) = logistic(x . weights - thresholds[k]), thresholds rising."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(row: np.ndarray, number: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int) -> Ordinal:
    """Penalised maximum likelihood by Adam on sparse rows; grades 0 to K."""
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    top = max(top, 1)
    share = np.clip([(grade > k).mean() if n else 0.0 for k in range(top)], 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        theta = p[width] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, value * w[number], minlength=n)
        above = _sigmoid(score[:, None] - theta)  # n x top
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        own, slope = edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], edge * (1 - edge)
        d = np.zeros((n, top + 2))  # of the log-likelihood by each edge's argument
        d[np.arange(n), grade] += slope[np.arange(n), grade]
        d[np.arange(n), grade + 1] -= slope[np.arange(n), grade + 1]
        d /= np.maximum(own, 1e-12)[:, None]
        g_score, g_theta = d.sum(1), -d[:, 1:-1].sum(0)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(number, value * g_score[row], minlength=width), tail[:1], tail[1:] * gaps]) / max(n, 1)
        g[:width] -= RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(p[:width], p[width] + np.concatenate(([0.0], np.cumsum(np.exp(p[width + 1 :])))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> tuple[Lookup, Ordinal]:
    """Learns from `rows` labelled rows at most (doc_id, toxic 0 or 1), the first in the order of their ids' hashes.

    Labels with a grade column (0 to K) give the grades, of equal texts the rounded mean. Without one, the labels of
    equal texts are votes: grade 0 without a vote for toxic, 2 if all are, 1 where they are split. Labels that are null,
    or differ for one doc_id, teach nothing; of documents that share a doc_id the one with the smallest text teaches.
    Without labels nothing is toxic.
    """
    y = "grade" if "grade" in labels.columns else "toxic"
    sure = labels.where(F.col("doc_id").isNotNull() & F.col(y).isNotNull()).groupBy("doc_id").agg(F.min(y).cast("int").alias("y"), F.max(y).cast("int").alias("z")).where("y = z")
    sample = sure.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # a documented bound
    votes = F.when(F.max(F.col("y")) <= 0, 0).when(F.min(F.col("y")) > 0, 2).otherwise(1) if y == "toxic" else F.round(F.avg("y")).cast("int")
    seen = one.groupBy("text").agg(F.min("doc_id").alias("doc_id"), votes.alias("y"))
    whole = seen.agg(F.count("*"), F.count(F.when(F.col("y") > 0, 1))).first()
    n, t = (float(x) for x in whole)

    def term(k, e):
        return F.when(k > 0, k * F.log(k / e)).otherwise(0.0)

    a, b = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    size = F.col("n") / F.lit(max(n, 1.0))
    c, d = F.lit(t) - a, F.lit(n - t) - b
    g = 2 * (term(a, size * t) + term(b, size * (n - t)) + term(c, (1 - size) * t) + term(d, (1 - size) * (n - t)))
    found = seen.mapInArrow(_tally, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("t") >= MIN_ROWS)
    best = found.where(F.col("t") * n > F.col("n") * t).withColumn("g", g).where(F.col("g") > MIN_G).orderBy(F.desc("g"), "f").limit(vocabulary).select("f").collect()
    lookup = Lookup(np.array([r.f for r in best], np.int64).view(np.uint64))
    got = seen.mapInArrow(_sparse(seen.sparkSession.sparkContext.broadcast(lookup)), "doc_id long, y int, f array<int>, v array<double>").toPandas().sort_values("doc_id", kind="stable")  # `rows` rows at most
    grade = got.y.to_numpy().astype(int)
    row = np.repeat(np.arange(len(got)), np.array([len(x) for x in got.f], int))
    number = np.concatenate([np.zeros(0, int), *got.f.to_numpy()]).astype(int)
    value = np.concatenate([np.zeros(0), *got.v.to_numpy()])
    return lookup, fit_ordinal(row, number, value, grade, max(len(lookup.codes), 1))


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, ordinal = model.value
        for batch in chunks(batches, "text"):
            row, number, value = lookup.rows(column(batch, "text"))
            above = ordinal.above(np.bincount(row, value * ordinal.weights[number], minlength=batch.num_rows))
            top = np.concatenate([np.ones((batch.num_rows, 1)), above, np.zeros((batch.num_rows, 1))], axis=1)
            grade = (top[:, :-1] - top[:, 1:]).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(above.sum(1)), pa.array(grade), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], [*names, "severity", "grade", "p_toxic", "toxic"])

    return run


def grade(docs: DataFrame, model: tuple[Lookup, Ordinal]) -> DataFrame:
    """docs with severity (the expected grade), grade (the likeliest), p_toxic (P(grade > 0)) and toxic (p_toxic >= 0.5).

    A null or empty text has no feature and so the lowest severity. Of grades that tie the lower is the likeliest.
    Repeated rows get equal answers; input columns named like these are replaced.
    """
    docs = without(docs, "severity", "grade", "p_toxic", "toxic")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), docs.columns), f"{schema}, severity double, grade int, p_toxic double, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return grade(docs, model).select("doc_id", "severity", "grade", "p_toxic", "toxic")
