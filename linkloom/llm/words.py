"""Words, n-grams and hashes of whole Arrow batches at once, in numpy.

Texts of a batch are one byte buffer; words are spans of it. A span's hash is a polynomial over
its bytes (or over its words' hashes) modulo 2**64, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1) * 5 // 4
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of spans of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


class Words:
    """The words of a string array: byte spans, their rows, and per row the range of its words."""

    def __init__(self, texts: pa.Array, lower: bool = False, word_bytes: np.ndarray | None = None):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        base, end = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
        self.bytes = LOWER[self.raw] if lower else self.raw
        self.rows = offsets - base
        inside = ~_WS[self.raw] if word_bytes is None else word_bytes[self.raw]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        first = self.rows[:-1]
        before[first[first < len(inside)]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        last = self.rows[1:]
        after[last[last > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.of_row = np.searchsorted(self.start, self.rows)
        self.count = np.diff(self.of_row)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return Spans(BYTE[self.bytes]).hash(self.start, self.end, seed)

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes, apart from the hashes of whole words."""
        return Spans(BYTE[self.bytes]).hash(self.start, np.minimum(self.start + n, self.end), 0x70 + n)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        sizes = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        at, n = 0, batch.num_rows
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker waits for its next task


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
