"""Substring dedup by difference-cover anchors.

Anchors of ANCHOR words are hashed only at positions whose remainder modulo PERIOD lies in COVER,
a perfect difference set: for any two positions some shift below PERIOD brings both onto the
cover, so two equal runs of MIN_WORDS words always hold an anchor at the same place of the run.

1. Every anchor carries a hash of its neighbourhood, all words that a run through it can reach.
   Anchors are grouped by hash, first within a batch; those of one document only are dropped.
2. Where a holder has the same neighbourhood as the smallest document that holds the anchor, every
   run through it is shared: the neighbourhood goes, and nothing else is compared.
3. Where neighbourhoods differ (edges of shared passages), runs through the anchor are extended to
   MIN_WORDS words and compared by 96-bit hash.
Groups are reduced to a minimum and a maximum before the shuffle and joined back on a key by
which the aggregate isn't dealt out, so that AQE can split a passage that very many documents hold.

Nulls: a null text has no words and comes back null; a null doc_id is neither source nor receiver.
Rows that repeat a doc_id pool their spans. Empty and short texts come back unchanged. Input
columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SPACE, table, without
from .words import CHUNK_BYTES, Spans, Words, chunks, column, signed

MIN_WORDS = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [lo, hi), and the range each is from."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def _find(batch: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of a batch: its hash, its neighbourhood's, its row and its place in the document."""
    width, on = min_words - PERIOD + 1, np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    w = Words(column(batch, "text"))
    row = w.row()
    at = np.arange(len(w)) - w.of_row[row]
    n = w.count[row]
    pick = np.flatnonzero(on[at % PERIOD] & (at + width <= n) & (n >= min_words))
    of = Spans(w.hashes())
    lo = pick - np.minimum(at[pick], PERIOD - 1)
    hi = pick + np.minimum(n[pick] - at[pick], min_words)
    near = of.hash(lo, hi, 1) ^ (pick - lo).astype(np.uint64)
    return of.hash(pick, pick + width), (near >> np.uint64(32)).astype(np.uint32).view(np.int32), row[pick], at[pick].astype(np.int32)


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, _, row, pos = _find(batch, min_words)
            yield pa.RecordBatch.from_arrays([signed(h), column(batch, "doc_id").take(pa.array(row)), pos], ["h", "doc_id", "pos"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames: they cross the network once, and so take less of it and of the disks."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array([x and zip_.compress(x.encode()) if x else x if x is None else b"" for x in batch.column(i).to_pylist()], pa.binary()))


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_squeeze undone, a megabyte or so at a time."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            i = part.schema.get_field_index("text")
            yield part.set_column(i, "text", pa.array([unzip.decompress(x).decode() if x else x if x is None else "" for x in part.column(i).to_pylist()], pa.large_string()))


def _groups(min_words: int):
    """Anchors by hash, as far as 16 MB of text go: the smallest document, its neighbourhood, how far the largest is, and whether others differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 16 << 20):
            parts = [(h, near, np.asarray(column(c, "doc_id"))[row]) for c in chunks(iter([batch]), "text") for h, near, row, _ in [_find(c, min_words)]]
            h, near, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(h):
                continue
            order = np.lexsort((doc, h))
            h, near, doc = h[order], near[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            last = np.append(first[1:], len(h)) - 1
            other = np.maximum.reduceat(near != np.repeat(near[first], last - first + 1), first)
            yield pa.RecordBatch.from_arrays([signed(h[first]), near[first], doc[first], doc[last] - doc[first], pa.array(other)], ["h", "near", "lo", "span", "other"])

    return run


def _lists(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """A list column's values and the row of each."""
    lists = column(batch, name)
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))


def _sort_hits(batch: pa.RecordBatch, w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of the anchors that a batch's documents share, and whether each one's whole neighbourhood goes."""
    hits, row = _lists(batch, "hits")
    pos, of_lo, first = (np.asarray(hits.field(i)) for i in range(3))
    ok = pos < w.count[row]
    pos, of_lo, first, row = pos[ok], of_lo[ok], first[ok], row[ok]
    at = w.of_row[row] + pos
    lo = at - np.minimum(pos, PERIOD - 1)
    near = Spans(w.hashes()).hash(lo, at + np.minimum(w.count[row] - pos, min_words), 1) ^ (at - lo).astype(np.uint64)
    return row, pos, ((near >> np.uint64(32)).astype(np.uint32).view(np.int32) == of_lo) & ~first


def _windows(min_words: int, grouped: bool):
    """The windows through anchors that need a test; grouped: by hash, with the smallest document and how far the largest is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(_full(batches), "text", 8 * CHUNK_BYTES if grouped else CHUNK_BYTES):
            parts = []
            for part in chunks(iter([batch]), "text"):
                w = Words(column(part, "text"))
                row, pos, sure = _sort_hits(part, w, min_words)
                row, pos = row[~sure], pos[~sure]
                lo, hi = np.maximum(pos - PERIOD + 1, 0), np.minimum(pos, w.count[row] - min_words) + 1
                start, of = _ranges(lo + w.of_row[row], hi + w.of_row[row])
                start, first = np.unique(start, return_index=True)
                row = row[of[first]]
                k1 = Spans(w.hashes()).hash(start, start + min_words, 2)
                k2 = (Spans(w.hashes(5)).hash(start, start + min_words) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                parts.append((k1, k2, np.asarray(column(part, "doc_id").take(pa.array(row))), (start - w.of_row[row]).astype(np.int32)))
            k1, k2, doc, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(k1):
                continue
            if not grouped:
                yield pa.RecordBatch.from_arrays([signed(k1), k2, doc.astype(np.int64), p], ["k1", "k2", "doc_id", "p"])
                continue
            order = np.lexsort((doc, k2, k1))
            k1, k2, doc = k1[order], k2[order], doc[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
            last = np.append(first[1:], len(k1)) - 1
            yield pa.RecordBatch.from_arrays([signed(k1[first]), k2[first], doc[first], doc[last] - doc[first]], ["k1", "k2", "lo", "span"])

    return run


def _cut(min_words: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(_full(batches), "text"):
            texts = column(batch, "text")
            w = Words(texts)
            gone = np.zeros(len(w) + 1, np.int64)
            row, pos, sure = _sort_hits(batch, w, min_words)
            p, p_row = _lists(batch, "found")
            p = np.asarray(p)
            ok = p < w.count[p_row]
            for pos, row, left in ((pos[sure], row[sure], PERIOD - 1), (p[ok], p_row[ok], 0)):
                lo, hi = np.maximum(pos - left, 0), np.minimum(pos, w.count[row] - min_words) + min_words
                np.add.at(gone, w.of_row[row] + lo, 1)
                np.add.at(gone, w.of_row[row] + hi, -1)
            kept = np.cumsum(gone)[:-1] == 0
            removed = w.count - np.add.reduceat(np.append(kept, False), np.minimum(w.of_row[:-1], len(w))) * (w.count > 0)
            out = []
            for i, r in enumerate(removed):
                if not r:
                    out.append(texts[i].as_py())
                    continue
                a, b = w.of_row[i], w.of_row[i + 1]
                k = kept[a:b]
                edge = np.diff(np.concatenate(([False], k, [False])).astype(np.int8))
                runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                # a run of kept words keeps its own white space; runs are joined by the space before the later one
                parts = [(w.raw[w.end[a + s - 1] if s and j else w.start[a + s] : w.end[a + e - 1]]).tobytes() for j, (s, e) in enumerate(runs)]
                out.append(b"".join(parts).decode("utf-8", "replace"))
            same = [texts.cast(pa.string()) if c == "text" else column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*same, pa.array(out, pa.string()), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64))], [*names, "kept_text", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with kept_text (the text without repeated passages), n_words and n_removed.

    A word goes if it lies in min_words consecutive words that also stand in a document with a
    smaller doc_id. Judged on the input, so that the order of removal doesn't matter.
    """
    if min_words < PERIOD + 4:
        raise ValueError(f"min_words must be {PERIOD + 4} at least for this cover")
    docs = without(docs, "kept_text", "n_words", "n_removed", "hits", "found")
    slim = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    groups = slim.mapInArrow(_groups(min_words), "h long, near int, lo long, span long, other boolean")
    shared = (
        groups.repartition("h")  # rows are grouped within batches already; a second grouping before the exchange would only widen them
        .groupBy("h")
        .agg(F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("span")).alias("hi"), F.min_by("near", "lo").alias("of_lo"), (F.max("other") | (F.min("near") != F.max("near"))).alias("mixed"))
        .where("lo < hi")
        .select(F.col("h").bitwiseXOR(F.lit(1)).alias("g"), "lo", "of_lo", "mixed")
    )
    anchors = slim.mapInArrow(_anchors(min_words), "h long, doc_id long, pos int").select(F.col("h").bitwiseXOR(F.lit(1)).alias("g"), "doc_id", "pos")
    first = (F.col("doc_id") == F.col("lo")).alias("first")
    hits = anchors.join(shared, "g").where("mixed OR doc_id > lo").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "of_lo", first)).alias("hits"))
    light = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    placed = docs.mapInArrow(_squeeze, light).join(hits, "doc_id", "left")
    key = "k1 long, k2 int"
    firsts = (
        placed.mapInArrow(_windows(min_words, True), f"{key}, lo long, span long").repartition("k1")
        .groupBy("k1", "k2").agg(F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("span")).alias("hi"))
        .where("lo < hi").select(F.col("k1").bitwiseXOR(F.lit(1)).alias("g"), F.col("k2").alias("k2_"), "lo")
    )
    windows = placed.mapInArrow(_windows(min_words, False), f"{key}, doc_id long, p int").select(F.col("k1").bitwiseXOR(F.lit(1)).alias("g"), "k2", "doc_id", "p")
    found = windows.join(firsts, "g").where("k2 - k2_ = 0 AND doc_id > lo").groupBy("doc_id").agg(F.collect_list("p").alias("found"))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return placed.join(found, "doc_id", "left").select(*[placed[f"`{c}`"] for c in names], "hits", "found").mapInArrow(
        _cut(min_words, names), f"{schema}, kept_text string, n_words long, n_removed long"
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), SPACE, " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM words, unnest(range(1, len(w) - 48)) AS t(p) WHERE len(w) >= 50),
firsts AS (SELECT k, min(doc_id) AS lo FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list(p) AS ps FROM windows JOIN firsts USING (k) WHERE doc_id > lo GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS g FROM hit),
kept AS (
  SELECT doc_id, w, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
