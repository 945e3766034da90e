"""SimHash near-dedup by meet-in-the-middle ball hashing.

1. fingerprints: 64 majority bits over XXH64 of word shingles.
2. Equal fingerprints become one class. A class meets the next step only if another shares three
   of its six blocks of bits; differences in three places leave three blocks whole, so nothing
   that has a link is lost.
3. balls: every class emits the midpoints around it: itself, 64 with one bit flipped, and those with
   two bits flipped of the same half. Of three differing bits two lie in one half, so two classes
   within three bits meet: one has flipped two, the other one. Whatever has flipped one bit at
   most lies within three of all that meet there, so each midpoint gives a star, not all pairs.
4. components over the stars; a class is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .decontaminate import BITMAP_BITS, _bitmap
from .tables import keep, spread, table, without
from .words import Spans, Words, chunks, column, mix, signed

RADIUS = 3
_BLOCKS = [(1 << hi) - (1 << lo) for lo, hi in ((0, 11), (11, 22), (22, 33), (33, 43), (43, 54), (54, 64))]


def _long(x: int) -> Column:
    return F.lit(x - 2**64 if x >= 2**63 else x).cast("long")


def majority(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per run of hashes the 64 bits set in over half of it; an empty run gives zero."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


#: Fixed values of the published hash function XXH64.
_XXH = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of spans of a byte buffer: those under 32 bytes, most of them, all at once, the others one by one."""
    p1, p2, p3, p4, p5 = _XXH
    size = end - start
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray(len(raw) + 1, t, data.data, 0, (1,)) for t in ("<u8", "<u4"))  # a lane from every byte on
    h, at = size.astype(np.uint64) + p5 + np.uint64(seed), start.copy()
    short = size < 32
    for k in range(3):
        m = np.flatnonzero(short & (size >= 8 * k + 8))
        h[m] = _turned(h[m] ^ _turned(eight[at[m]] * p2, 31) * p1, 27) * p1 + p4
        at[m] += 8
    m = np.flatnonzero(short & (size & 4 > 0))
    h[m] = _turned(h[m] ^ four[at[m]].astype(np.uint64) * p1, 23) * p2 + p3
    at[m] += 4
    for k in range(3):
        m = np.flatnonzero(short & (size & 3 > k))
        h[m] = _turned(h[m] ^ data[at[m]].astype(np.uint64) * p5, 11) * p1
        at[m] += 1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    h ^= h >> np.uint64(32)
    whole = raw.tobytes()
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(whole[start[i] : end[i]], seed)
    return h


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat = [b" ".join((t or "").encode().lower().split()) for t in column(batch, "text").to_pylist()]  # bytes.lower: A-Z alone
            w = Words(pa.array([x.decode("utf-8", "replace") for x in flat], pa.large_string()))
            take = np.minimum(w.count, shingle)
            n = np.where(w.count > 0, w.count - take + 1, 0)
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - first[row] + w.of_row[row]
            h = xxh64(w.raw, w.start[at], w.end[at + take[row] - 1], seed)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), signed(majority(h, first, n))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long): a null or empty text has fingerprint zero."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def _near(classes: DataFrame) -> DataFrame:
    """The classes of which another shares three of six blocks; all that have a link are among them."""
    masks = [sum(c) for c in combinations(_BLOCKS, 3)]
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_long(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.i", "x.k")
    met = keyed.groupBy("i", "k").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select(F.col("i").alias("i_"), "k")
    return keyed.join(met.hint("merge"), "k").where("i - i_ = 0").select("fp").distinct()


def _balls(classes: DataFrame) -> DataFrame:
    """m, fp, inner (one bit flipped at most)."""
    one = [0, *(1 << i for i in range(64))]
    two = [(1 << (i + half)) | (1 << (j + half)) for half in (0, 32) for i, j in combinations(range(32), 2)]
    flips = F.array(*[_long(x) for x in one + two])
    return classes.select("fp", F.posexplode(flips).alias("i", "x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("m"), "fp", (F.col("i") < len(one)).alias("inner"))


# The joins below carry a hint: Spark sizes an exploded table as if it had not grown, and would broadcast it.


def links(classes: DataFrame) -> DataFrame:
    """u, v: stars that join exactly the classes (fp) within three bits of each other, step by step."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = _balls(keep(_near(classes)).repartition(parts, "fp"))  # a few rows become very many: all tasks take part
    met = (
        balls.groupBy("m", F.shiftright("m", 62).alias("deal"))
        .agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("u"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("a < b AND u IS NOT NULL").select(F.col("m"), "u")
    )
    collided = balls.join(met.hint("merge"), "m").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    return collided.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)  # verified


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id: documents linked by fingerprints of three differing bits at most.

    component_id is the smallest doc_id that links reach. A null or empty text has fingerprint zero
    and is linked like any other. Rows with a null doc_id have a null component unless a class has
    other ids; repeated rows come back as often. Only doc_id and text of docs are read.
    """
    marked = keep(fingerprints(docs, shingle))
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = keep(components(links(classes)))
    named = classes.join(roots, classes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root", F.shiftright("root", 62).alias("deal")).agg(F.min("least").alias("component_id")).select(F.col("root"), "component_id")
    of = keep(named.join(least, "root").select("fp", "component_id"))
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of 0.8: SimHash's three bits stand for shingle sets that share 95 % or more, so pairs of a lower
# similarity are proposed by min-hash bands as well. See the README for the share that each finds.
HASHES, BANDS, BAND_ROWS = 128, 16, 4
#: Min-hashes only propose: a pair goes on to its exact similarity if they agree in this much less, seven standard errors.
#: BLOCK: texts of a bucket that meet as many others of it in a task.
MARGIN, BLOCK = 0.25, 256
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, ...]:
    """All hashes, their first and count by text; the distinct ones and their text; texts that have some, where they begin, and the hash of each text's set."""
    w = Words(texts, lower=True)
    take = np.minimum(w.count, shingle)
    n = np.where(w.count > 0, w.count - take + 1, 0)
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - first[row] + w.of_row[row]
    all_ = Spans(w.hashes()).hash(at, at + take[row])
    order = np.lexsort((all_, row))
    h, row = all_[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)]
    h, row = h[new], row[new]
    some = np.flatnonzero(n)
    edge = np.searchsorted(row, some)
    whole = np.zeros(len(n), np.uint64)
    if len(some):
        whole[some] = np.add.reduceat(mix(h), edge)
    return all_, first, n, h, row, some, edge, whole


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            all_, first, n, h, row, some, edge, whole = _shingles(column(batch, "text"), shingle)
            fp = majority(all_, first, n)
            low = np.full((len(n), HASHES), np.iinfo(np.uint32).max, np.uint32)
            if len(some):
                for i, m in enumerate(_MULTIPLIERS):
                    low[some, i] = np.minimum.reduceat(((h * m) >> np.uint64(32)).astype(np.uint32), edge)
            bands = np.zeros((len(n), BANDS), np.uint64)
            for b in range(BANDS):
                for r in range(BAND_ROWS):
                    bands[:, b] = mix(bands[:, b] * np.uint64(31) + low[:, b * BAND_ROWS + r] + np.uint64(b + 1))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(x)) for k, x in ((BANDS, signed(bands.ravel())), (HASHES, low.ravel().view(np.int32)))]
            size = pa.array(np.bincount(row, minlength=len(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), signed(fp), signed(whole), size, *lists], ["doc_id", "fp", "whole", "size", "bands", "low"])

    return run


def _sets(shingle: int, bitmap):
    """whole, set: of the texts that the bitmap of wanted sets lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in chunks(batches, "text"):
            *_, n, h, row, _, _, whole = _shingles(column(batch, "text"), shingle)
            k = whole >> np.uint64(64 - BITMAP_BITS)
            hit = (bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1
            once = np.zeros(len(n), bool)
            once[np.unique(whole, return_index=True)[1]] = True
            hit &= once
            size = np.bincount(row, minlength=len(n))[hit]
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([signed(whole[hit]), pa.ListArray.from_arrays(offsets, pa.array(signed(h[hit[row]])))], ["whole", "set"])

    return run


def _sets_of(slim: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """whole, set (the distinct shingles' hashes), once for each whole; those wanted are among them."""
    cells = wanted.select(F.col("whole").alias("h")).mapInArrow(_bitmap, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toPandas()  # 2**BITMAP_BITS / 8 rows at most
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    bits[cells["at"].to_numpy()] = cells["byte"].to_numpy()
    sets = slim.select("text").mapInArrow(_sets(shingle, slim.sparkSession.sparkContext.broadcast(bits.tobytes())), "whole long, set array<long>")
    return keep(sets.groupBy("whole").agg(F.first("set").alias("set")))


def _proposed(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """u, v, same (min-hashes that agree): without the pairs that sizes rule out, or min-hashes by far."""
    low = sketches.select("whole", "low", "size")
    both = (
        pairs.join(low.withColumnsRenamed({"whole": "u", "low": "a", "size": "m"}).hint("merge"), "u").join(low.withColumnsRenamed({"whole": "v", "low": "b", "size": "n"}).hint("merge"), "v")
        .where(F.least("m", "n") + 1e-6 >= similarity * F.greatest("m", "n"))
    )
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.select("u", "v", same.alias("same")).where(F.col("same") >= (similarity - MARGIN) * HASHES)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose sets have this Jaccard similarity or more."""
    both = pairs.join(sets.withColumnsRenamed({"whole": "u", "set": "a"}).hint("merge"), "u").join(sets.withColumnsRenamed({"whole": "v", "set": "b"}).hint("merge"), "v")
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return common.where(F.col("common") + 1e-6 >= similarity * (F.col("total") - F.col("common"))).select("u", "v")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("whole"))


def _spanning(texts: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """u, v: pairs of this Jaccard similarity or more that join what may be joined of two roots; pairs that others have joined by then are not tested."""
    texts = texts.combine_chunks()
    whole, root, x, y, part = (texts.column(c).to_numpy() for c in ("whole", "root", "x", "y", "part"))
    sets = texts.column("set")
    size = pc.list_value_length(sets).to_numpy().astype(np.int64)
    first = np.cumsum(size) - size
    _, own = np.unique(root, return_inverse=True)
    values, of = np.unique(pc.list_flatten(sets).to_numpy(), return_inverse=True)
    held, pairs = np.zeros(len(values), bool), []
    for i in range(len(whole) - 1):
        j = np.arange(i + 1, len(whole))
        j = j[(own[j] != own[i]) & (np.minimum(size[j], size[i]) + 1e-6 >= similarity * np.maximum(size[j], size[i])) & ((x[j] == y[j]) | (part[j] != part[i]))]
        if not len(j):
            continue
        held[of[first[i] : first[i] + size[i]]] = True
        edge = np.cumsum(size[j]) - size[j]
        common = np.add.reduceat(held[of[np.arange(size[j].sum()) + np.repeat(first[j] - edge, size[j])]], edge, dtype=np.int64)
        held[of[first[i] : first[i] + size[i]]] = False
        for m in j[common + 1e-6 >= similarity * (size[i] + size[j] - common)]:
            if own[m] != own[i]:
                pairs.append((whole[i], whole[m]))
                own[own == own[m]] = own[i]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def _links_of_blocks(similarity: float):
    """Rows come sorted by (k, x, y): one block after the other is held."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _spanning(pa.Table.from_batches(parts), similarity)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key = [], None
        for batch in batches:
            keys = np.stack([column(batch, c).to_numpy() for c in ("k", "x", "y")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if open_ and tuple(keys[a]) != key:
                        yield found(open_)
                        open_ = []
                    key = tuple(keys[a])
                    open_.append(batch.slice(a, b - a))
        if open_:
            yield found(open_)

    return run


def _untested(slim: DataFrame, classes: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame | None:
    """u, v: links that join the groups (roots) of alike texts that share a bucket; None if no bucket has texts of two groups.

    A bucket's texts are dealt into blocks of some BLOCK texts, and each pair of blocks meets in a task, with the whole sets. No
    pair is a row: a task tests the pairs of two groups that it hasn't joined yet, and hands on the links that join two.
    """
    of = classes.select("whole", "bands").join(roots, classes.whole == roots.node, "left").select("whole", F.coalesce("root", "whole").alias("root"), F.explode("bands").alias("k"))
    crossed = of.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("held")).where("a < b").select(F.col("k").bitwiseXOR(F.lit(1)).alias("g"), "held")
    members = keep(of.withColumn("g", F.col("k").bitwiseXOR(F.lit(1))).join(crossed.hint("merge"), "g").select("k", "whole", "root", F.ceil(F.col("held") / BLOCK).alias("blocks")))
    if members.isEmpty():
        return None
    own = members.withColumn("part", F.pmod(F.xxhash64("whole"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = own.join(_sets_of(slim, shingle, members.select("whole").distinct()).hint("merge"), "whole")
    blocks = met.select("k", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "whole", "root", "set").repartition("k", "x", "y").sortWithinPartitions("k", "x", "y")
    return keep(blocks.mapInArrow(_links_of_blocks(similarity), "u long, v long"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents linked by shingle sets of this Jaccard similarity or more.

    Pairs come from ball hashing of the fingerprints and from min-hash bands; each is decided by its two whole sets. First
    every text of a band's bucket meets one of it, a star for each of the bands; then whatever shares a bucket and isn't in
    one group already. Documents without a word, null texts among them, are one group, as are equal shingle sets, however
    long. A null doc_id has no say in a group's name; repeated rows come back as often. An empty table gives no rows.
    Only doc_id and text of docs are read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = keep(slim.mapInArrow(_sketches(shingle), "doc_id long, fp long, whole long, size int, bands array<long>, low array<int>"))
    classes = keep(marked.groupBy("whole").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "bands", "low")]))
    of_fp = classes.groupBy("fp").agg(F.min("whole").alias("first"))
    stars = links(of_fp.select("fp"))
    near = (
        stars.join(of_fp.withColumnsRenamed({"fp": "u", "first": "a"}), "u").join(of_fp.withColumnsRenamed({"fp": "v", "first": "b"}), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(classes.join(of_fp, "fp").where("whole <> first").select(F.col("first").alias("u"), F.col("whole").alias("v")))
    )
    held = classes.select(F.explode("bands").alias("k"), "whole")
    hub = held.groupBy("k").agg(F.min_by("whole", F.xxhash64("k", "whole")).alias("u"), F.count("*").alias("n")).where("n > 1").select(F.col("k").bitwiseXOR(F.lit(1)).alias("g"), "u")
    starred = held.withColumn("g", F.col("k").bitwiseXOR(F.lit(1))).join(hub.hint("merge"), "g").where("whole <> u").select("u", F.col("whole").alias("v"))
    pairs = keep(_proposed(near.unionByName(starred).distinct(), classes, similarity).select("u", "v"))
    edges = keep(_alike(pairs, _sets_of(slim, shingle, _ends(pairs)), similarity))
    roots = keep(components(edges))
    rest = _untested(slim, classes, roots, shingle, similarity)
    if rest is not None and not rest.isEmpty():
        roots = keep(components(edges.unionByName(rest).distinct()))
    named = classes.select("whole", "least").join(roots, classes.whole == roots.node, "left").withColumn("root", F.coalesce("root", "whole"))
    least = named.groupBy("root", F.shiftright("root", 62).alias("deal")).agg(F.min("least").alias("component_id")).select("root", "component_id")  # grouped wider than joined, so that AQE can split a large group
    of = keep(named.join(least, "root").select("whole", "component_id"))
    return marked.select("doc_id", "whole").join(of, "whole").select("doc_id", "component_id")
