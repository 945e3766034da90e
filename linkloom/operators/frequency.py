"""Document frequencies asked for by blocks of documents, so that no row of a term crosses the network."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Hashes of terms that a task counts at once, on average.
PART_TERMS = 4_000_000


def lists(values: pa.Array, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), values)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(strings: list[str | None]) -> np.ndarray:
    return np.array([0 if s is None else int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little") for s in strings], np.uint64)


def _asked(rows, parts: int):
    """part, block, terms, counts: the terms of documents of a block, each once a batch, dealt by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    h, count = np.unique(rows(pa.Table.from_batches([batch.slice(a, b - a)])), return_counts=True)
                    part = (h % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    some, size = np.unique(part, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), blocks[a])), lists(pa.array(h[order].view(np.int64)), size), lists(pa.array(count[order].astype(np.int32)), size)], ["part", "block", "terms", "counts"])

    return run


def _answered(min_df: int):
    """block, terms, dfs: of the terms in min_df documents at least."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        terms, counts = (pc.list_flatten(part.column(c)).to_numpy() for c in ("terms", "counts"))
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("terms")).to_numpy())
        _, one = np.unique(terms, return_inverse=True)
        df = np.bincount(one, counts).astype(np.int64)[one]
        fine = df >= min_df
        size = np.bincount(row[fine], minlength=part.num_rows)
        return pa.table({"block": part.column("block"), "terms": lists(pa.array(terms[fine]), size), "dfs": lists(pa.array(df[fine]), size)})

    return run


def answers(documents: DataFrame, rows: Callable[[pa.Table], np.ndarray], terms: int, min_df: int) -> DataFrame:
    """block, terms (hashes), dfs: the document frequencies, from min_df on, of the terms of each block. documents: block, and what `rows` makes the 64-bit hashes of a document's distinct terms from; terms: about how many."""
    parts = max(2 * documents.sparkSession.sparkContext.defaultParallelism, terms // PART_TERMS)
    asked = documents.mapInArrow(_asked(rows, parts), "part long, block long, terms array<long>, counts array<int>")
    return asked.groupBy("part").applyInArrow(_answered(min_df), "block long, terms array<long>, dfs array<long>")


def met(h: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are answered, and their df."""
    terms, place = np.unique(pc.list_flatten(answers.column("terms")).to_numpy(), return_index=True)
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(terms, h.view(np.int64)), len(terms) - 1)
    found = np.flatnonzero(terms[at] == h.view(np.int64))
    return found, pc.list_flatten(answers.column("dfs")).to_numpy()[place][at[found]]


def idf(docs: np.ndarray, df: np.ndarray) -> np.ndarray:
    pair, one = np.unique(docs + 1j * df, return_inverse=True)
    return np.array([math.log(1 + (x - y + 0.5) / (y + 0.5)) for x, y in zip(pair.real.tolist(), pair.imag.tolist(), strict=True)])[one]
