"""Sharding by minimax contiguous partition.

Equal texts form an atomic group; groups stand in the order of their text's hash. The smallest
feasible shard capacity is found by binary search, each candidate checked greedily over prefix
sums. The driver never sees all groups: it starts from the sums of 65536 hash ranges and refines
only those ranges in which a greedy cut can fall, sixteen bits at a time, until they hold a group each.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import keep, table, without

STEP_BITS = 16
#: A window that numbers rows takes about so many; a text held by more than a thousandth of all rows is spread.
ROWS_A_BUCKET, HEAVY = 4096, 1000


def reach(prefix: list[int], start: int, capacity: int) -> int:
    """The furthest end of a shard that starts at an index of the prefix sums."""
    return bisect_right(prefix, prefix[start] + capacity) - 1


def feasible(prefix: list[int], shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = reach(prefix, at, capacity)
    return at == len(prefix) - 1


def capacity(prefix: list[int], shards: int, low: int, high: int) -> int:
    """The smallest feasible capacity from low to high; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(prefix, shards, mid) else (mid + 1, high)
    return low


def cuts(prefix: list[int], shards: int, limit: int) -> list[int]:
    """Ends of the shards: none over limit, each as near as it can be to an equal part of what is left."""
    latest, at = [len(prefix) - 1], len(prefix) - 1  # from behind: the first start from which the rest still fits
    for _ in range(shards - 1):
        want = prefix[at] - limit
        at = next_at if (next_at := bisect_right(prefix, want - 1)) < at else at
        latest.append(at)
    least = latest[::-1]
    ends, at = [], 0
    for i in range(shards):
        target = prefix[at] + (prefix[-1] - prefix[at]) / (shards - i)
        end = bisect_right(prefix, target) - 1
        if end + 1 < len(prefix) and prefix[end + 1] - target < target - prefix[end]:
            end += 1
        end = max(min(max(end, least[i]), reach(prefix, at, limit)), at)
        ends.append(end)
        at = end
    return ends


def _sums(groups: DataFrame, bits: int) -> list:
    return [tuple(r) for r in groups.groupBy(F.shiftright("h", 64 - bits).alias("k")).agg(F.sum("size"), F.count("*"), F.max("size"), F.max("h")).collect()]


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """The last hash of every shard but the last. groups: h (long, distinct), size (long)."""
    # items: first key at 64 bits, bits, size, groups, largest group, last hash
    items = sorted((k << (64 - STEP_BITS), STEP_BITS, s, n, top, last) for k, s, n, top, last in _sums(groups, STEP_BITS))
    if not items:
        return []
    while True:
        prefix = [0]
        for x in items:
            prefix.append(prefix[-1] + x[2])
        low = max(-(-prefix[-1] // shards), max(x[4] for x in items))
        high = capacity(prefix, shards, low, max(low, prefix[-1]))
        active, least, most = set(), 0, 0
        for _ in range(shards):  # a cut lies between the greedy ones of low and of high, wherever inside its item
            least = reach(prefix, least, low)
            most = min(reach(prefix, most, high) + 1, len(items))
            active.update(i for i in range(max(least - 1, 0), most) if items[i][3] > 1)
            least = max(least - 1, 0) if least < len(items) else least
        if not active or high == low:
            break
        parts = []
        for bits in sorted({items[i][1] for i in active}):
            found = [items[i][0] >> (64 - bits) for i in active if items[i][1] == bits]
            finer = min(64, bits + STEP_BITS)
            parts += [(k << (64 - finer), finer, *x) for k, *x in _sums(groups.where(F.shiftright("h", 64 - bits).isin(found)), finer)]
        items = sorted([x for i, x in enumerate(items) if i not in active] + parts)
    ends = cuts(prefix, shards, high)[:-1]
    return [items[e - 1][5] if e else -(2**63) for e in ends]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with text_hash, size (UTF-8 bytes and 1), shard and slot (gapless from 0 in each shard).

    Shards are contiguous in text_hash, equal texts share a shard, and the largest shard is as small
    as any such cut allows. A null text counts as an empty one. A null doc_id or a repeated row has a
    slot like any other; a table without rows gives none. Input columns named like these are replaced.
    """
    docs = without(docs, "text_hash", "size", "shard", "slot")
    text = F.coalesce("text", F.lit(""))
    sized = docs.withColumns({"text_hash": F.xxhash64(text), "size": F.octet_length(text).cast("long") + 1})
    groups = keep(sized.groupBy(F.col("text_hash").alias("h")).agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    last = boundaries(groups, shards)
    buckets = 1 << max(0, min(16, (max(rows, 1) // ROWS_A_BUCKET).bit_length()))
    most = max(ROWS_A_BUCKET, rows // HEAVY)
    heavy = [r.h for r in groups.where(F.col("n") > most).select("h").collect()]  # fewer than HEAVY

    def bucket() -> Column:
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
        own = F.pmod(F.shiftright("text_hash", 48), F.lit(buckets))
        return (F.when(F.col("text_hash").isin(heavy), spread).otherwise(own) if heavy else own).cast("int")

    placed = sized.withColumns({"shard": sum((F.when(F.col("text_hash") > x, 1).otherwise(0) for x in last), F.lit(0)).cast("int"), "__b": bucket()})
    counts = placed.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    before = counts.select("shard", "__b", (F.sum("__n").over(W.partitionBy("shard").orderBy("__b")) - F.col("__n")).alias("__before"))
    number = F.row_number().over(W.partitionBy("shard", "__b").orderBy("text_hash", "doc_id"))
    slotted = placed.withColumn("__i", number).join(before, ["shard", "__b"])
    return slotted.select(*[placed[f"`{c}`"] for c in sized.columns], "shard", (F.col("__i") - 1 + F.col("__before")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))))
    return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
