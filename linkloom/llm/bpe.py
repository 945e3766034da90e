"""Byte-level BPE: texts to ids by merges in the order of their rank, and ids to texts.

A text falls into pieces that no merge crosses. Symbols are a doubly linked list, broken between pieces; a queue holds the
merges of neighbours by rank, then place. The first is made: the right symbol goes, its neighbours are linked, and the two
new pairs are queued. Entries whose symbols have changed since are skipped when they come up. Thousands of
pieces that a worker hasn't met yet are merged in step, by numpy; long ones go on alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table, without
from .words import chunks, column

BATCH_BYTES = 2 << 20
#: Stretches that a worker remembers from batch to batch, and the characters of the longest among them.
CACHE_STRETCHES, CACHE_CHARS = 400_000, 64
#: Stretches whose pieces are merged together, and how many times their queues' heads are taken at once.
AT_ONCE, AT_ONCE_ROUNDS = 20_000, 40
#: White space of Unicode; what a byte-level tokenizer splits a text into; the bytes that stand for themselves in its vocabulary.
SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+"
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Words with the space before them, and white space: each holds whole pieces, whatever stands around it.
_STRETCH = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_PIECE = regex.compile(PIECE)
_coders: dict[tuple[str, bool], "Coder"] = {}


class Coder:
    """A tokenizer file's vocabulary and merges. It must be byte-level BPE without a normaliser, a prefix space, or special tokens that take spaces along. One that only decodes holds the strings alone."""

    def __init__(self, path: str, encodes: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        if model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or not plain or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        others = iter(range(256, 512))
        sign = {b: chr(b) if b in set(OWN_BYTES) else chr(next(others)) for b in range(256)}
        back = {c: b for b, c in sign.items()}
        vocab = model["vocab"]
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for text, i in chain(vocab.items(), self.added.items()):
            self.strings[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
        if encodes:
            self._merges(model, [vocab[sign[b]] for b in range(256)])

    def _merges(self, model: dict, of_byte: list[int]) -> None:
        vocab = model["vocab"]
        self.bits = len(self.strings).bit_length()
        self.of_byte = np.array(of_byte)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs])  # by rank: the id that a merge makes, and the pair that it takes
        self.taken = np.array([vocab[a] << self.bits | vocab[b] for a, b in pairs])
        self.rank = {pair: rank for rank, pair in enumerate(self.taken.tolist())}
        self.of_pair = np.argsort(self.taken)
        self.pairs = self.taken[self.of_pair]
        self.first_rank = np.array([[self.rank.get(int(a) << self.bits | int(b), -1) for b in self.of_byte] for a in self.of_byte])
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers

    def merge(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The ids of bytes, -1 where one was merged into an id before it. begins: which bytes begin a piece.

        Each piece has a queue, ordered by rank, then place. The queues of all pieces are one sorted array by piece, and the heads of
        all are taken at once, AT_ONCE_ROUNDS times; pieces that need more, long ones, go on with a heap.
        """
        n = len(data)
        ids = np.append(self.of_byte[data], -1)  # the last is no symbol; links that lead nowhere lead there
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.flatnonzero(begins)
        after[edge[1:] - 1], before[edge] = n, n
        place, kind = n.bit_length(), len(self.made).bit_length()
        piece = np.cumsum(begins) << place + kind
        rank = np.where(begins[1:], -1, self.first_rank[data[:-1], data[1:]]) if n else np.zeros(0, int)
        at = np.flatnonzero(rank >= 0)
        queue = np.sort(piece[at] | rank[at] << place | at)
        for _ in range(AT_ONCE_ROUNDS):
            at, rank = queue & (1 << place) - 1, queue >> place & (1 << kind) - 1
            live = ids[at] << self.bits | ids[after[at]]
            fresh = live == self.taken[rank]  # others are stale
            queue, at, rank = queue[fresh], at[fresh], rank[fresh]
            if not len(queue):
                break
            head = np.ones(len(queue), bool)
            head[1:] = queue[1:] >> place + kind != queue[:-1] >> place + kind
            at, new = at[head], self.made[rank[head]]
            right = after[at]
            following, previous = after[right], before[at]
            ids[at], ids[right] = new, -1
            after[at], before[following] = following, at
            pairs = np.concatenate([new << self.bits | ids[following], ids[previous] << self.bits | new])
            found = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            known = self.pairs[found] == pairs
            at = np.concatenate([at, previous])[known]
            queue = np.sort(np.concatenate([queue[~head], piece[at] | self.of_pair[found[known]] << place | at]))
        return (ids if not len(queue) else self._merge_rest(ids, after, before, queue, place, kind))[:n]

    def _merge_rest(self, ids: np.ndarray, after: np.ndarray, before: np.ndarray, queue: np.ndarray, place: int, kind: int) -> np.ndarray:
        """The same with one heap for all pieces that are left, entry by entry."""
        n = len(ids) - 1
        ids, after, before = ids.tolist(), after.tolist(), before.tolist()
        queue = np.sort(queue & (1 << place + kind) - 1).tolist()  # sorted, it is a heap
        ranks, made, taken, bits, low = self.rank.get, self.made.tolist(), self.taken.tolist(), self.bits, (1 << place) - 1
        while queue:
            entry = heappop(queue)
            at, rank = entry & low, entry >> place
            right = after[at]
            if ids[at] << bits | ids[right] != taken[rank]:
                continue  # stale
            new = made[rank]
            ids[at], ids[right] = new, -1
            after[at] = following = after[right]
            before[following], previous = at, before[at]
            if following < n and (found := ranks(new << bits | ids[following])) is not None:
                heappush(queue, found << place | at)
            if previous < n and (found := ranks(ids[previous] << bits | new)) is not None:
                heappush(queue, found << place | previous)
        return np.array(ids)

    def _learn(self, stretches: list[str]) -> None:
        """Works out the ids of stretches."""
        held = [s.encode() for s in stretches]
        bounds = np.cumsum([0, *map(len, held)])
        data = np.frombuffer(b"".join(held), np.uint8)
        begins = np.zeros(len(data), bool)
        begins[bounds[:-1]] = True
        for s, at in zip(stretches, bounds.tolist(), strict=False):
            if not (s.isascii() and (s[1:].isalpha() if s[0] == " " else s.isalpha())):  # those are one piece
                for piece in _PIECE.findall(s)[:-1]:
                    at += len(piece.encode())
                    begins[at] = True
        ids = self.merge(data, begins)
        stays = ids >= 0
        bounds = (4 * np.concatenate(([0], np.cumsum(stays)))[bounds]).tolist()
        flat = ids[stays].astype(np.int32).tobytes()
        for s, a, b in zip(stretches, bounds, bounds[1:], strict=False):
            self.known[s] = flat[a:b]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Added tokens that it spells out are theirs, whole."""
        taken = []
        for t in texts:
            parts = self.split.split(t) if self.added and any(a in t for a in self.added) else [t]  # every other one is an added token
            taken.append([[p] if i % 2 else _STRETCH.findall(p) for i, p in enumerate(parts)])
        known = self.known
        new = list(set().union(*(held for parts in taken for held in parts[::2])).difference(known))
        for at in range(0, len(new), AT_ONCE):
            self._learn(new[at : at + AT_ONCE])
        whole = {t: np.array([i], np.int32).tobytes() for t, i in self.added.items()}
        ids = [np.frombuffer(b"".join([b"".join(map((whole if i % 2 else known).__getitem__, held)) for i, held in enumerate(parts)]), np.int32) for parts in taken]
        if len(known) > CACHE_STRETCHES:
            known.clear()
        for s in new:
            if len(s) > CACHE_CHARS:
                known.pop(s, None)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids' strings in a row; bytes that aren't become replacement signs."""
        held = b"".join(map(self.strings.__getitem__, ids))
        try:
            held.decode()
        except UnicodeDecodeError:
            held = held.decode(errors="replace").encode()
        return held


def coder(path: str, encodes: bool = True) -> Coder:
    if (path, encodes) not in _coders:
        _coders[path, encodes] = Coder(path, encodes)
        pa.default_memory_pool().release_unused()
    return _coders[path, encodes]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH_BYTES):
            ids = coder(path).encode([t or "" for t in column(batch, "text").to_pylist()])
            bounds = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], [*batch.schema.names, "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = column(batch, "ids")
            texts = [None if ids is None else coder(path, False).decode(ids) for ids in (x.as_py() for x in held)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "decoded"])

    return run


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs with ids: the tokens of the whole text.

    A null text counts as an empty one, which has no ids. Texts of any length are encoded whole, and a piece of n bytes in
    n log n steps. Rows that repeat get equal ids, an empty table gives no rows, other columns stay as they are (one named ids is
    replaced). The file is read once by each worker, which remembers CACHE_STRETCHES.
    """
    docs = without(docs, "ids")
    return docs.mapInArrow(_encode(tokenizer_path), f"{_fields(docs)}ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (ids) with decoded: the strings of the ids in a row, special ones too.

    Null ids are null, none an empty text. An id that the vocabulary lacks is an error. Other columns stay as they are.
    """
    encoded = without(encoded, "decoded")
    return encoded.mapInArrow(_decode(tokenizer_path), f"{_fields(encoded)}decoded string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    there = decode(encode(docs, path).drop("text"), path)
    return there.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
