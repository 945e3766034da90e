"""Retrieval over postings: sparse dot products, containment, vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import micro
from linkloom.sources.scratch import keep


def top(df: DataFrame, group: str, score: str, ident: str, k: int) -> DataFrame:
    """The k best of each group, ties by the smaller id; rank from 1."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), ident))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


#: Postings of a block of queries on average, which a worker holds; how many times as many a block of documents has, which passes by it; sums that a task holds at once.
BLOCK, PASSING, CELLS = 8_000_000, 3, 1 << 19


def _postings(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """ids, kinds, least, and by posting: row, term, weight."""
    rows = rows.combine_chunks()
    ids, kinds, least = (pc.fill_null(rows.column(c), np.iinfo(np.int64).min).to_numpy() for c in ("id", "kind", "least"))
    size = pc.list_value_length(rows.column("terms")).to_numpy()
    term, weight = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("terms", "weights"))
    return ids, kinds, least, np.repeat(np.arange(len(ids)), size), term, weight


class _Queries:
    """A block of queries, and the k best of each so far (all are handed on where k is null)."""

    def __init__(self, rows: pa.Table, k: int | None, apart: bool, selves: bool):
        self.src, self.kind, self.least, self.row, term, self.weight = _postings(rows)
        self.known, place = np.unique(term, return_inverse=True)
        self.place, self.k, self.apart, self.selves = place.astype(np.int32), k, apart, selves
        self.best = (np.empty(0, np.int64),) * 3  # query, document, score
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def meet(self, documents: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """Sums of products with these documents, as whole numbers."""
        dst, kind, _, d_row, d_term, d_weight = _postings(documents)
        order = np.argsort(d_term, kind="stable")
        term, began, size = np.unique(d_term[order], return_index=True, return_counts=True)
        d_row, d_weight, wide = d_row[order], d_weight[order], len(dst)
        if not len(self.known) or not len(term):
            return
        of = np.full(len(self.known), -1, np.int32)
        at = np.minimum(np.searchsorted(self.known, term), len(self.known) - 1)
        held = np.flatnonzero(self.known[at] == term)
        of[at[held]] = held
        at = of[self.place]
        met = np.flatnonzero(at >= 0)
        at = at[met]
        q_row, q_weight, began, size = self.row[met], self.weight[met], began[at], size[at]
        ends = np.searchsorted(q_row, np.arange(len(self.src) + 1))
        work = np.concatenate(([0], np.cumsum(size)))[ends]  # products before each query
        low = 0
        while low < len(self.src):
            high = min(max(np.searchsorted(work, work[low] + CELLS, "right") - 1, low + 1), low + max(CELLS // wide, 1), len(self.src))
            own = slice(ends[low], ends[high])
            n = size[own]
            place = np.arange(n.sum()) + np.repeat(began[own] - (np.cumsum(n) - n), n)
            cell = np.repeat((q_row[own] - low) * wide, n) + d_row[place]
            sums, seen = np.zeros((high - low) * wide, np.int64), np.zeros((high - low) * wide, bool)
            np.add.at(sums, cell, np.repeat(q_weight[own], n) * d_weight[place])
            seen[cell] = True
            cell = np.flatnonzero(seen)
            q, value = cell // wide + low, sums[cell]
            fine = value >= self.least[q]
            cell, q, value = cell[fine], q[fine], value[fine]
            d = cell - (q - low) * wide
            fine = np.full(len(q), True) if self.selves else self.src[q] != dst[d]
            if self.apart:
                fine &= self.kind[q] != kind[d]
            q, d, value = q[fine], dst[d[fine]], value[fine]
            if self.k is None:
                yield self.src[q], d, value
            else:
                self._take(q, d, value)
            low = high

    def _take(self, q: np.ndarray, d: np.ndarray, value: np.ndarray) -> None:
        """Sums (by query) that may be among the best."""
        edges = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1, [len(q)]))
        crowded = np.flatnonzero(np.diff(edges) > self.k)
        if len(crowded):
            fine = np.ones(len(q), bool)
            for a, b in zip(edges[crowded].tolist(), edges[crowded + 1].tolist(), strict=True):  # equal ones stay, as their documents decide
                fine[a:b] = value[a:b] >= np.partition(value[a:b], b - a - self.k)[b - a - self.k]
            q, d, value = q[fine], d[fine], value[fine]
        self.waiting.append((q, d, value))
        if sum(len(x[0]) for x in self.waiting) > max(len(self.best[0]), CELLS):
            self._settle()

    def _settle(self) -> None:
        """Only the k best stay, of equal ones the smaller document, and what doesn't reach the last of them isn't taken from now on."""
        q, d, value = (np.concatenate([self.best[i], *(x[i] for x in self.waiting)]) for i in range(3))
        order = np.lexsort((d, -value, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[rank < self.k]
        self.best, self.waiting = (q[order], d[order], value[order]), []
        last = rank[rank < self.k] == self.k - 1
        self.least = self.least.copy()
        self.least[self.best[0][last]] = np.maximum(self.least[self.best[0][last]], self.best[2][last])

    def rest(self) -> tuple[np.ndarray, ...]:
        self._settle()
        return self.src[self.best[0]], *self.best[1:]


def _multiply(k: int | None, apart: bool, selves: bool):
    """A block of queries (side 0, which come first) by one of documents (side 1), a batch at a time: of each query the k best, of what reaches its least, if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["src", "dst", "score"])
        asked, queries = [], None
        for batch in batches:
            first = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if first:
                asked.append(batch.slice(0, first))
            if first < batch.num_rows and (asked or queries):
                if queries is None:
                    queries, asked = _Queries(pa.Table.from_batches(asked), k, apart, selves), []
                yield from map(made, queries.meet(pa.Table.from_batches([batch.slice(first)])))
        if queries is not None and k is not None:
            yield made(queries.rest())

    return run


def scores(queries: DataFrame, postings: DataFrame, k: int | None = None, least: Column | None = None, apart: bool = False, selves: bool = False) -> DataFrame:
    """src, dst, score: sums of products of weights over shared terms; both have doc_id, lang, term, weight (whole numbers, terms once a document).

    With k at least the k best of each query, ties by the smaller dst, and few more; with least, an aggregate over a query's
    rows, only what reaches it; apart: both have a column kind, and pairs of one kind are left out; selves: a query meets
    the document of its number too, as they are of two kinds. Pairs grow with the square
    of the table, so none crosses the network: queries and documents are dealt into blocks of BLOCK and PASSING * BLOCK postings, and
    each block of the ones meets each of the others in a task. The task holds its queries and their k best, the documents pass by. Terms
    are known by 64-bit hashes.
    """
    kind = F.xxhash64("kind") if apart else F.lit(None).cast("long")

    def rows(df: DataFrame, bound: Column | None) -> DataFrame:
        one = F.struct(F.xxhash64("lang", "term").alias("t"), F.col("weight").cast("long").alias("w"))
        found = df.where("lang IS NOT NULL AND term IS NOT NULL").groupBy("doc_id").agg(F.collect_list(one).alias("x"), F.first(kind).alias("kind"), (F.lit(None) if bound is None else bound).cast("long").alias("least"))
        return found.select(F.col("doc_id").alias("id"), F.col("x.t").alias("terms"), F.col("x.w").alias("weights"), "kind", "least", F.xxhash64("doc_id").alias("h"))

    asked, held = queries.count(), postings.count()
    a, b = max(1, -(-asked // BLOCK)), max(1, -(-held // (PASSING * BLOCK)))
    while a * b < 2 * queries.sparkSession.sparkContext.defaultParallelism:  # the side that costs less is sent once more
        a, b = (2 * a, b) if 2 * a * held + b * asked < a * held + 2 * b * asked else (a, 2 * b)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows(queries, least).withColumns({"own": F.pmod("h", F.lit(a)), "other": each(b), "side": F.lit(0)}).withColumn("cell", F.col("own") * b + F.col("other"))
    right = rows(postings, None).withColumns({"own": F.pmod("h", F.lit(b)), "other": each(a), "side": F.lit(1)}).withColumn("cell", F.col("other") * b + F.col("own"))
    cols = (F.col("cell").cast("int").alias("cell"), "side", "id", "terms", "weights", "kind", "least")
    dealt = left.select(*cols).unionByName(right.select(*cols)).repartitionById(a * b, "cell").sortWithinPartitions("side")
    return dealt.drop("cell").mapInArrow(_multiply(k, apart, selves), "src long, dst long, score long")


def similar(queries: DataFrame, postings: DataFrame, k: int, excluded: DataFrame | None = None, allowed: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """src, dst, rank, score: the k with the best scores for each query, without excluded pairs (src, dst), among allowed targets (dst), both before the cut; apart: see scores."""
    held = postings if allowed is None else postings.join(allowed.select(F.col("dst").alias("doc_id")), "doc_id", "left_semi")
    if excluded is None:
        found = scores(queries, held, k, apart=apart)
    else:  # as many more as any one query can lose
        pairs = excluded.select("src", "dst").distinct()
        most = pairs.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        found = scores(queries, held, k + most, apart=apart).join(pairs, ["src", "dst"], "left_anti")
    return top(found, "src", "score", "dst", k).select("src", "dst", "rank", "score")


def containing(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """query, doc_id, rank, score: sums of the weights of a query's terms in a document, whatever its language. terms: query, term; postings: all that documents hold."""
    asked = terms.select("query", "term").distinct()
    held = keep(postings.join(asked.select("term").distinct(), "term", "left_semi").select("doc_id", F.lit("").alias("lang"), "term", "weight"))
    found = scores(asked.select(F.col("query").alias("doc_id"), F.lit("").alias("lang"), "term", F.lit(1).alias("weight")), held, k, selves=True)
    return top(found, "src", "score", "dst", k).select(F.col("src").alias("query"), F.col("dst").alias("doc_id"), "rank", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 where a vector is null or of another length, or has no length."""
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm_a > 0) & (norm_b > 0)
    return F.when(fits, dot(a, b) / (norm_a * norm_b)).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, deals: int = 32) -> DataFrame:
    """src, dst, rank, cosine (millionths): a stated set of queries against all vectors of their partition (id, part, vector).

    Partitions are few and large: the vectors of each are dealt into `deals` parts, and the queries go to every one of them.
    """
    seen = vectors.withColumns({"norm": F.sqrt(dot(F.col("vector"), F.col("vector"))), "deal": F.pmod(F.xxhash64("id"), F.lit(deals)).cast("int")})
    asked = queries.select(F.col("id").alias("src"), "part", F.col("vector").alias("q"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("q_norm"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    pairs = asked.join(seen, ["part", "deal"]).where("src <> id")
    scored = pairs.select("src", F.col("id").alias("dst"), micro(cosine(F.col("q"), F.col("vector"), F.col("q_norm"), F.col("norm"))).alias("cosine"))
    return top(scored, "src", "cosine", "dst", k).select("src", "dst", "rank", "cosine")


def rescale(scored: DataFrame, group: str, value: str) -> Column:
    """A value between its group's least (0) and greatest (1); 1 where all are equal."""
    w = W.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col(value) - low) / (high - low))


def blend(lexical: Column, semantic: Column, weight: float = 0.5) -> Column:
    """Lexical relevance alone where there is no semantic one; the result lies between 0 and 1."""
    return F.least(F.greatest(F.when(semantic.isNull(), lexical).otherwise((1 - weight) * lexical + weight * semantic), F.lit(0.0)), F.lit(1.0))


def fill_up(first: DataFrame, second: DataFrame, cap: int) -> DataFrame:
    """target, origin, branch, rank: all of the first branch, then those of the second that the first lacks, up to cap. Both: target, origin, score."""
    more = second.join(first.select("target", "origin"), ["target", "origin"], "left_anti")
    both = first.withColumn("branch", F.lit(0)).unionByName(more.withColumn("branch", F.lit(1)))
    rank = F.row_number().over(W.partitionBy("target").orderBy("branch", F.desc("score"), "origin"))
    return both.withColumn("rank", rank).where(F.col("rank") <= cap).select("target", "origin", "branch", "rank")
