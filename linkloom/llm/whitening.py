"""Whitening of embeddings by a covariance that is exact until it is solved.

Entries become whole numbers. By polarisation no product of two dimensions is ever taken: tasks add up the squares of
every centred dimension and of every sum of two, as whole numbers, and what the variance of a sum exceeds the two variances
by is twice the covariance. Vectors are centred on the whole part of each mean first; what that leaves, less than one, is
taken off exactly with whole numbers of any size. The matrix, d x d, is rounded once and solved for its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from .tables import spread, table, without
from .words import column

#: What entries are multiplied by before they are cut to whole numbers, and what is added.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Vectors are read so many entries at a time; more dimensions are an error, as the matrix lies in the driver.
BLOCK_ENTRIES, MAX_DIMENSIONS = 1 << 18, 2048
#: Sums are added up in three parts of so many bits, so that Spark's longs hold them over a million tasks and more.
PART_BITS = 40
#: An eigenvalue under this share of the greatest, times the dimensions, is a zero that was rounded.
ZERO = 2.0**-50


@dataclass
class Whitener:
    """n vectors with sums S by dimension; directions (d x k): components over the roots of their eigenvalues; explained: shares of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]
    identity_error: float


def whole(vectors: DataFrame, name: str) -> DataFrame:
    """vectors with a valid vector in `name`, and with x, its entries floor(SCALE c) + SHIFT as longs.

    Left out are null vectors, empty ones, and those with an entry that is null or not finite. An entry beyond the range of longs is an error.
    """
    c = F.col(f"`{name}`")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(fine).withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        x = column(batch, "x")
        step = max(1, BLOCK_ENTRIES // max(1, len(x[0]) if len(x) else 1))
        for at in range(0, len(x), step):
            part = x.slice(at, step)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _parts(sums: list[int]) -> pa.RecordBatch:
    cut = lambda i: [s >> PART_BITS * i & (1 << PART_BITS) - 1 if i < 2 else s >> PART_BITS * 2 for s in sums]
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), *[pa.array(cut(i), pa.int64()) for i in range(3)]], ["cell", "a", "b", "c"])


def _exact(block: np.ndarray, of) -> list[int]:
    """Sums by column of of(block), exactly: with 64 bits where no sum can pass them, else with whole numbers of any size. of: what is added, quadratic at most, of two entries at most."""
    high = max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0))))
    wide = (2 * high) ** 2 * max(1, len(block)) >= 1 << 62
    return [int(s) for s in of(block.astype(object) if wide else block).sum(axis=0)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells: the number of vectors, then the sum of each dimension."""
    total: list[int] = []
    for x in _blocks(batches):
        part = [len(x), *_exact(x, lambda b: b)]
        total = [a + b for a, b in zip(total, part, strict=True)] if total else part
    if total:
        yield _parts(total)


def _squares(centre: list[int]):
    """Cells: the sum of squares of each centred dimension, then of each sum of two, by the first, then the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total = len(centre), []
        for x in _blocks(batches):
            y = x - np.array(centre, np.int64)
            part = _exact(y, lambda b: b**2)
            for i in range(d - 1):
                part += _exact(y[:, i:], lambda b: (b[:, :1] + b[:, 1:]) ** 2)
            total = [a + b for a, b in zip(total, part, strict=True)] if total else part
        if total:
            yield _parts(total)

    return run


def _added(x: DataFrame, of) -> list[int]:
    """The cells' sums over all tasks; as many rows as there are cells, whatever the number of vectors."""
    cells = x.select("x").mapInArrow(of, "cell int, a long, b long, c long").groupBy("cell").agg(*[F.sum(p).alias(p) for p in "abc"])
    found = cells.toArrow().sort_by("cell").to_pydict()
    return [a + (b << PART_BITS) + (c << 2 * PART_BITS) for a, b, c in zip(found["a"], found["b"], found["c"], strict=True)]


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariances, divisor n, each rounded once. rest: the sum of each centred dimension; squares: see _squares.

    n times a sum of squares less the square of the sum is n * n times the variance, in whole numbers. The cross-covariance is
    half of what the variance of the sum exceeds the two variances by.
    """
    d = len(rest)
    own = [n * q - r * r for q, r in zip(squares, rest, strict=False)]
    out = np.zeros((d, d))
    both = iter(squares[d:])
    for i in range(d):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (n * next(both) - (rest[i] + rest[j]) ** 2 - own[i] - own[j]) / (2 * n * n)
    return out


def fit(vectors: DataFrame, name: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """Learns from all valid vectors (see `whole`), in two passes. No valid vector: no components.

    All must be of one length, up to MAX_DIMENSIONS. Components are those of eigenvalues greater than zero: fewer than asked
    for where vectors have fewer dimensions, or vary in fewer.
    """
    x = whole(vectors, name)
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).limit(2).collect()
    if len(lengths) > 1 or lengths and lengths[0].d > MAX_DIMENSIONS:
        raise ValueError(f"vectors must be of one length, up to {MAX_DIMENSIONS}: {[r.d for r in lengths]}")
    if not lengths:
        return Whitener(0, [], np.zeros((0, 0)), [], 0.0)
    n, *sums = _added(x, _sums)
    centre = [s // n for s in sums]
    v = covariance(n, [s - n * m for s, m in zip(sums, centre, strict=True)], _added(x, _squares(centre)))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > ZERO * len(e) * max(e[0], 0)).sum()))
    directions = u[:, :k] / np.sqrt(e[:k])
    error = np.abs(directions.T @ v @ directions - np.eye(k)).max(initial=0.0)
    return Whitener(n, sums, directions, [float(s) for s in e[:k] / np.trace(v)] if k else [], float(error))


def _whiten(model: Whitener, names: list[str]):
    n, sums, k = model.n, model.sums, model.directions.shape[1]
    centre = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK_ENTRIES // max(1, len(sums)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = column(part, "x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(sums))
                y = x - np.array(centre, np.int64)
                high = n * (int(np.abs(y).max(initial=0)) + 1)
                z = (y if high**2 * len(sums) < 1 << 63 else y.astype(object)) * n - np.array(rest, object if high**2 * len(sums) >= 1 << 63 else np.int64)
                deviation = (z * z).sum(axis=1)
                white = (y - np.array(rest) / n) @ model.directions
                exact = pa.array([int(v) for v in deviation], pa.decimal128(38, 0))
                scores = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * k, pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in names], exact, scores], [*names, "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, model: Whitener, name: str = "embedding") -> DataFrame:
    """vectors that are valid (see `whole`), with deviation (decimal, exact: the sum over dimensions of (n x - S)²) and whitened (an array, an entry a component).

    Whitened entries over the vectors of the fit have mean 0 and the identity as covariance. Rows that repeat get equal
    answers; other columns stay as they are, and those named x, deviation or whitened are replaced. Nothing learned: no rows.
    """
    if name.lower() in ("x", "deviation", "whitened"):
        raise ValueError(f"the vectors' column may not be named {name}")
    vectors = without(vectors, "x", "deviation", "whitened")
    names = vectors.columns
    schema = StructType([*vectors.schema.fields, StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    fine = whole(vectors, name).where(F.lit(model.n > 0))
    if not model.n:
        return fine.drop("x").withColumns({"deviation": F.lit(None).cast("decimal(38,0)"), "whitened": F.lit(None).cast("array<double>")})
    return fine.mapInArrow(_whiten(model, names), schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid embeddings, a row for each of their components."""
    vectors = spread(table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", "embedding")
    model = fit(vectors)
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
