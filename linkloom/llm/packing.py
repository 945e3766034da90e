"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to the smallest of the tiers (context sizes) that holds what is left of them once whole windows of
the largest tier are cut off; every tier is a pool of its own. Pools are packed from the longest tier down: the longest
piece of the pool opens a window, the gap is filled by whole pieces, the largest that fits first, of the same pool and then
of shorter tiers', and one last piece of the shortest pool is cut to the gap's length; what is left of it is routed anew.
Windows are then dealt to step groups: each tier's go round the groups, so that all groups hold the same number of
windows of a tier, give or take one.

A task packs what it reads, batch by batch, and carries what is left into the next; no token crosses the network, and only
the last window of a task can be padded. A token's document, and so its window, depends on the input's splits alone, so that
a retried task gives the same rows. For the step groups the pieces, without tokens, are written once; a task's windows
are numbered from those of the tasks before it, tier by tier.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import keep, spread, table
from .words import BYTE, Spans, Words, chunks, column

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16384
BATCH_BYTES = 2 << 20
CACHE_PIECES = 500_000
#: Bytes that open or make up pieces which every regular expression of the tokenizer keeps apart: ASCII letters and the letters of Latin-1 on one side, ASCII signs on the other.
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<"]] = True
_coders: dict[str, "Coder"] = {}


class Coder:
    """Ids of whole batches by a tokenizer with word ends whose normaliser lowers and drops white space.

    Words fall into pieces, runs of letters and runs of signs, that the tokenizer's pre-tokeniser
    keeps apart. A batch's new pieces are encoded in one call, by the same model without the
    normaliser and the pre-tokeniser, and told apart again by their word ends. Words with
    anything else in them (digits, apostrophes, other scripts, special tokens) are encoded whole, each
    distinct one once, by the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        suffix = spec["model"]["end_of_word_suffix"]
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for x, i in spec["model"]["vocab"].items() if x.endswith(suffix)]] = True
        self._forget()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's closed by end_id, and where each text's begin (and the end)."""
        w = Words(texts, lower=True)
        raw = w.raw
        two = np.zeros(len(raw) + 1, bool)  # first bytes of Latin-1 letters
        if len(raw) > 1:
            two[: len(raw) - 1] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0xBF) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        second = np.concatenate(([False], two[:-2])) if len(raw) else two[:0]
        two = two[: len(raw)]
        data = w.bytes + (second & (raw <= 0x9E)) * np.uint8(32)
        letter, sign = _LETTER[raw] | two | second, _SIGN[raw]
        odd = np.concatenate(([0], np.cumsum(~(letter | sign))))
        slow = odd[w.end] > odd[w.start]
        edge = np.zeros(len(raw), bool)  # a letter after a sign or the other way round
        edge[1:] = letter[1:] != letter[:-1]
        inner = np.flatnonzero(edge)
        word = np.searchsorted(w.start, inner, "right") - 1
        keep = (word >= 0) & ~slow[np.maximum(word, 0)] if len(w) else np.zeros(len(inner), bool)
        inner, word = inner[keep], word[keep]
        keep = (inner > w.start[word]) & (inner < w.end[word])
        start = np.sort(np.concatenate([w.start, inner[keep]]))
        of_word = np.searchsorted(w.start, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), w.end[of_word]) if len(start) else start
        odd_piece = slow[of_word] if len(start) else np.zeros(0, bool)
        h = Spans(BYTE[data]).hash(start, end) ^ odd_piece.astype(np.uint64)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        ids, begin, size = self._known(h[first], data, start[first], end[first], odd_piece[first], raw)
        n = size[which]
        done = np.concatenate(([0], np.cumsum(n)))
        bounds = done[np.searchsorted(start, w.rows)]
        per_text = bounds + np.arange(len(bounds))
        out = np.full(per_text[-1], end_id, np.uint32)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out[np.arange(done[-1]) + row] = ids[np.arange(done[-1]) - np.repeat(done[:-1], n) + np.repeat(begin[which], n)]
        return out, per_text

    def _known(self, h: np.ndarray, *pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each distinct piece (hash h, rising) begin and how many they are; a worker remembers CACHE_PIECES of them."""
        if len(self.hashes) > CACHE_PIECES:
            self._forget()
        data, start, end, slow, raw = pieces
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != h) if len(self.hashes) else np.arange(len(h))
        if len(new):
            ids, size = self._distinct(data, start[new], end[new], slow[new], raw)
            order = np.argsort(np.concatenate([self.hashes, h[new]]), kind="stable")
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.hashes = np.concatenate([self.hashes, h[new]])[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hashes, h)
        return self.ids, self.begin[at], self.size[at]

    def _forget(self) -> None:
        self.hashes, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, slow: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and how many each has."""
        size = np.zeros(len(start), np.int64)
        fast = np.flatnonzero(~slow)
        n = end[fast] - start[fast]
        joined = np.full(n.sum() + len(fast), 32, np.uint8)  # a space after each
        place = np.arange(n.sum())
        piece = np.repeat(np.arange(len(fast)), n)
        joined[place + piece] = data[place - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[fast], n)]
        ids = np.array(self.pieces.encode(joined.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(fast):
            raise ValueError("the tokenizer's word ends don't tell the pieces apart")
        size[fast] = np.diff(np.concatenate(([-1], last)))
        rest = [self.whole.encode(raw[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(start[slow].tolist(), end[slow].tolist(), strict=True)]
        size[slow] = [len(x) for x in rest]
        at = np.cumsum(size) - size
        out = np.zeros(size.sum(), np.uint32)
        out[np.arange(len(ids)) - np.repeat(np.cumsum(size[fast]) - size[fast], size[fast]) + np.repeat(at[fast], size[fast])] = ids
        for a, x in zip(at[slow].tolist(), rest, strict=True):
            out[a : a + len(x)] = x
        return out, size


def coder(path: str) -> Coder:
    """One for each tokenizer and worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Packer:
    """Packs pieces (document, start, length) into windows of the tiers' sizes; keeps what is left for the next batch."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier: length, document, start; sorted

    def route(self, length: int) -> int:
        return bisect_left(self.tiers, length)

    def waiting(self) -> set[int]:
        return {d for pool in self.pools for _, d, _ in pool}

    def _fill(self, tier: int, gap: int) -> tuple[int, int, int] | None:
        """The piece that goes into a gap of a window of this tier: document, start, length."""
        for pool in self.pools[tier::-1]:
            if (i := bisect_right(pool, (gap, float("inf"), 0)) - 1) >= 0:
                n, d, s = pool.pop(i)
                return d, s, n
        for pool in self.pools[: tier + 1]:  # none fits whole: the shortest is cut
            if pool:
                n, d, s = pool.pop(0)
                insort(self.pools[self.route(n - gap)], (n - gap, d, s + gap))
                return d, s, gap
        return None

    def windows(self, documents: list[tuple[int, int]], last: bool = False) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(tier, pieces (document, start, length)) of every full window; with last, of every window."""
        top = self.tiers[-1]
        for doc, n in documents:
            whole = n // top * top
            for start in range(0, whole, top):
                yield top, [(doc, start, top)]
            if n > whole:
                self.pools[self.route(n - whole)].append((n - whole, doc, whole))
        for pool in self.pools:
            pool.sort()
        held = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pools[tier]:
                length, doc, start = self.pools[tier].pop()
                window, gap = [(doc, start, length)], self.tiers[tier] - length
                while gap and (piece := self._fill(tier, gap)):
                    window.append(piece)
                    gap -= piece[2]
                if not gap:
                    yield self.tiers[tier], window
                else:  # every pool from here down is empty
                    held = window
        if last and held:
            yield from self.close(held)
        elif held:
            for d, s, n in held:
                insort(self.pools[self.route(n)], (n, d, s))

    def close(self, window: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """A task's last pieces: full windows of smaller tiers first, then one that is padded."""
        for tier in self.tiers[::-1]:
            while sum(n for _, _, n in window) >= tier:
                out, gap = [], tier
                while gap:
                    d, s, n = window.pop(0)
                    out.append((d, s, min(n, gap)))
                    if n > gap:
                        window.insert(0, (d, s + gap, n - gap))
                    gap -= out[-1][2]
                yield tier, out
        if window:
            yield self.tiers[-1], window


def _pack(path: str, end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, sequence, of_tier = Packer(tiers), 0, dict.fromkeys(tiers, 0)
        ids: dict[int, np.ndarray] = {}  # of documents with pieces that aren't placed yet
        doc_ids: dict[int, int | None] = {}
        serial = 0

        def rows(windows: Iterator) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for tier, pieces in windows:
                offset = 0
                for d, start, n in pieces:
                    out.append((doc_ids[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), (task << 33) + sequence, offset, tier, task, of_tier[tier]))
                    offset += n
                sequence += 1
                of_tier[tier] += 1
            kept = packer.waiting()
            for d in [d for d in ids if d not in kept]:
                del ids[d], doc_ids[d]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * len(_NAMES), _TYPES, strict=True)], _NAMES)

        for batch in chunks(batches, "text", BATCH_BYTES):
            flat, bounds = coder(path).encode(column(batch, "text"), end_id)
            documents = []
            for i, doc in enumerate(column(batch, "doc_id").to_pylist()):
                ids[serial], doc_ids[serial] = flat[bounds[i] : bounds[i + 1]], doc
                documents.append((serial, len(ids[serial])))
                serial += 1
            yield rows(packer.windows(documents))
            for d in ids:
                ids[d] = ids[d].copy()  # what waits doesn't hold the whole batch
        yield rows(packer.windows([], last=True))

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "of_tier"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """pieces (with tier, task and of_tier, a window's number among the task's of its tier) with step_group.

    There are as many groups as step_tokens go into all windows' sizes, rounded up. A tier's windows are numbered through all
    tasks and go round the groups, each tier's from where the one above left off.
    """
    per = pieces.where("offset = 0").groupBy("task", "tier").agg(F.count("*").alias("n"))  # a row for each task and tier
    groups = F.greatest(F.lit(1), F.ceil(F.sum(F.col("tier") * F.col("n")).over(W.partitionBy()) / step_tokens)).cast("long")
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("tier"), "task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = per.select("task", "tier", before.alias("before"), groups.alias("groups"))
    return pieces.join(places, ["task", "tier"]).withColumn("step_group", (F.col("before") + F.col("of_tier")) % F.col("groups")).drop("task", "of_tier", "before", "groups")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every id of every document lies in one piece. A null text counts as an empty one, whose only id is end_id. A null
    doc_id is kept as null; rows that repeat are documents of their own. Texts of any length are cut into whole windows;
    an empty table gives no rows. Other columns of docs aren't read. The tokenizer must be one that Coder can split (see there).
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, of_tier long"
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(tokenizer_path, end_id, tuple(tiers)), schema)
    return step_groups(keep(pieces), step_tokens)


def op5_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents")) if docs is None else docs
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
