"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning sums n-gram counts per language over all rows that may be learned from: each task adds up
its batches in a languages x features matrix and emits its cells, which Spark sums. The matrix of
log-probabilities has a fixed number of features and at most MAX_LANGS rows, checked before it is
broadcast. Scoring adds up the log-probabilities of a text's n-grams, batch by batch, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table, without
from .words import LOWER, Words, chunks, column, mix

FEATURES, SIZES, MAX_LANGS = 1 << 14, (1, 2, 3), 512
SMOOTHING = 0.5
UNKNOWN = "und"
#: A letter is of the Unicode categories L*: numerals such as ½ or Ⅷ are none.
_LETTER = regex.compile(r"\p{L}")


def grams(texts: pa.Array, features: int = FEATURES, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size of n-gram: its feature and the row of each n-gram of bytes that doesn't cross texts. White space counts as one byte; A-Z are lowered."""
    w = Words(texts)
    data = LOWER[w.raw].astype(np.uint64)
    row = np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
    for n in sizes:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | data[i : len(data) - n + 1 + i]
        whole = row[: len(code)] == row[n - 1 :]
        yield (mix(code[whole] + np.uint64(n << 32)) % np.uint64(features)).astype(np.int64), row[: len(code)][whole]


def _count(features: int, sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in chunks(batches, "text"):
            langs = column(batch, "lang").dictionary_encode()
            names, which = langs.dictionary.to_pylist(), np.asarray(langs.indices)
            if len(rows.keys() | set(names)) > MAX_LANGS:
                raise ValueError(f"more than {MAX_LANGS} languages")
            cells = np.zeros(len(names) * features, np.int64)
            for feature, row in grams(column(batch, "text"), features, sizes):
                cells += np.bincount(which[row] * features + feature, minlength=len(cells))
            for name, part, n in zip(names, cells.reshape(len(names), features), np.bincount(which, minlength=len(names)), strict=True):
                sums[name] = sums.get(name, 0) + part
                rows[name] = rows.get(name, 0) + int(n)
        for name, part in sums.items():
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(part[at], rows[name]))], ["lang", "feature", "n"])

    return run


class Model:
    """Languages, their log-priors and the matrix features x languages of log-probabilities."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp


def fit(learn: DataFrame, features: int = FEATURES, sizes: tuple[int, ...] = SIZES, smoothing: float = SMOOTHING) -> Model:
    """Learns from text and lang of every row with a lang. More than MAX_LANGS languages are an error."""
    named = learn.select(F.coalesce("text", F.lit("")).alias("text"), "lang").where("lang IS NOT NULL")
    cells = named.mapInArrow(_count(features, sizes), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = cells.toPandas()  # at most MAX_LANGS x (features + 1) rows
    langs = sorted(set(found.lang))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    n = np.full((features, len(langs)), smoothing)
    docs = np.ones(len(langs))
    for i, lang in enumerate(langs):
        own = found[found.lang == lang]
        at, count = own.feature.to_numpy(), own.n.to_numpy()
        n[at[at >= 0], i] += count[at >= 0]
        docs[i] += count[at < 0].sum()
    return Model(langs, np.log(docs / docs.sum()), np.log(n / n.sum(0)).astype(np.float32))


def _score(model, features: int, sizes: tuple[int, ...], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in chunks(batches, "text"):
            texts, n = column(batch, "text"), batch.num_rows
            total, length = np.zeros((n, len(m.langs))), np.zeros(n)
            for feature, row in grams(texts, features, sizes):
                code, count = np.unique(row * features + feature, return_counts=True)  # sparse: each feature of a text once
                of, x = code // features, code % features
                edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
                if len(edge):
                    total[of[edge]] += np.add.reduceat(m.logp[x] * count[:, None], edge, axis=0)
                    length[of[edge]] += np.add.reduceat(count, edge)
            # n-grams overlap and repeat words, so that their sum is far too sure: the posterior is taken as of a tenth of them
            post = total / np.maximum(1, np.minimum(10, length / 10))[:, None] + m.prior
            post = np.exp(post - post.max(1, keepdims=True)) if len(m.langs) else post
            letters = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()])
            if len(m.langs):
                best = (total + m.prior).argmax(1)
                pred = [m.langs[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)]
                score = np.where(letters, post[np.arange(n), best] / post.sum(1), 0.0)
            else:
                pred, score = [UNKNOWN] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "lang_score"])

    return run


def identify(docs: DataFrame, model: Model, features: int = FEATURES, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1), from text alone.

    A text that is null, empty or without a letter is `und` with score 0, as is every text if nothing
    was learned. Of languages that tie the first by name wins. Repeated rows get equal answers; input
    columns named lang_pred or lang_score are replaced.
    """
    docs = without(docs, "lang_pred", "lang_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), features, sizes, docs.columns), f"{schema}, lang_pred string, lang_score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
