"""Sharding by minimax contiguous partition.

Documents of equal text form an atomic group.  Groups are ordered by a hash of their text and cut into
consecutive runs, so that the largest run is as small as it can be: the smallest feasible capacity is found by
binary search, each candidate checked by greedy filling.  A group larger than an even share gets a shard of its
own, before the others are balanced over what is left.

Only sums over ranges of the hash reach the driver, at most ``MAX_BLOCKS`` at a time.  Ranges in which a cut may
fall are split further until the cut falls between two groups, so the answer is that of the whole list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import written

HASH_BITS = 60
FIRST_BITS = 14
MAX_BLOCKS = 1 << 16
ROW_OVERHEAD = 8
ROWS_A_SLOT_BUCKET = 100_000
SLOT_BUCKETS = (64, 4096)


@dataclass(frozen=True)
class Block:
    """Groups whose hash starts with ``prefix``, after dropping ``shift`` bits."""

    prefix: int
    shift: int
    size: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << self.shift

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.shift == 0


class _Fill:
    """Greedy filling of shards from blocks in hash order."""

    def __init__(self, blocks: list[Block], shards: int):
        self.blocks, self.shards = blocks, shards
        self.ends = np.cumsum([b.size for b in blocks], dtype=np.int64) if blocks else np.zeros(0, np.int64)
        self.total = int(self.ends[-1]) if blocks else 0

    def cuts(self, capacity: int, divisible: bool) -> list[int] | None:
        """Positions at which shards end, or None if they don't hold everything.

        divisible: a block of several groups may be cut anywhere, else nowhere.
        """
        at, out = 0, []
        for _ in range(self.shards):
            if at >= self.total:
                break
            k = int(np.searchsorted(self.ends, at + capacity, "right"))
            end = int(self.ends[k - 1]) if k else 0
            if divisible and k < len(self.blocks) and not self.blocks[k].atomic:
                end = at + capacity
            if end <= at:
                return None
            at = end
            out.append(at)
        return out if at >= self.total else None

    def smallest(self, divisible: bool) -> int:
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, divisible) else (middle + 1, high)
        return low


def _sums(groups: DataFrame, blocks: list[Block], bits: int) -> list[Block]:
    """The blocks, each split by its next ``bits`` bits."""
    out: list[Block] = []
    spark = groups.sparkSession
    for shift in sorted({b.shift for b in blocks}):
        to = max(0, shift - bits)
        wanted = spark.createDataFrame([(b.prefix,) for b in blocks if b.shift == shift], "prefix long")
        rows = (
            groups.withColumn("prefix", F.shiftright("h", shift))
            .join(F.broadcast(wanted), "prefix")
            .groupBy(F.shiftright("h", to).alias("block"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("groups"))
            .collect()
        )
        out += [Block(r.block, to, r.size, r.groups) for r in rows]
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and, in hash order, the first hash of each shard.

    groups: h (distinct, of HASH_BITS bits), size.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    blocks = _sums(groups, [Block(0, HASH_BITS, 0, 2)], FIRST_BITS)
    while True:
        blocks.sort(key=lambda b: b.start)
        fill = _Fill(blocks, shards)
        if not blocks:
            return 0, []
        low, high = fill.smallest(divisible=True), fill.smallest(divisible=False)
        rough, fine = fill.cuts(high, divisible=False), fill.cuts(high, divisible=True)
        if low == high:
            break
        near = []
        begins = fill.ends - np.array([b.size for b in blocks])
        for k, late in enumerate(fine):
            early = _early(fill, low, k)
            a, z = np.searchsorted(fill.ends, early, "left"), np.searchsorted(begins, late, "right")
            near += [i for i in range(int(a), int(z)) if not blocks[i].atomic]
        near = sorted(set(near))
        if not near:
            break
        bits = max(1, int(np.log2(MAX_BLOCKS / len(near))))
        split = _sums(groups, [blocks[i] for i in near], bits)
        gone = set(near)
        blocks = [b for i, b in enumerate(blocks) if i not in gone] + split
    starts, begins = [], fill.ends - np.array([b.size for b in blocks])
    for at in [0, *rough[:-1]]:
        starts.append(blocks[int(np.searchsorted(begins, at, "left"))].start)
    return high, starts


def _early(fill: _Fill, capacity: int, k: int) -> int:
    """A position that the end of shard ``k`` can't come before, at any capacity from this one up."""
    at = 0
    for _ in range(k + 1):
        i = int(np.searchsorted(fill.ends, at + capacity, "right"))
        at = max(at, int(fill.ends[i - 1]) if i else 0)
    return at


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus ROW_OVERHEAD; a null text has no bytes and the CRC of none.  The law is
    ``bytes``: sizes near equal, never splitting documents of equal text.  slot counts from 0 without a gap in
    each shard; grown_shard is null under this law.  Rows that repeat a document id are all kept.  Null ids are
    kept too.  An empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS).alias("h"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    whole = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.sum("n").alias("n")).first()
    # fewer than `shards` groups can exceed an even share
    large = groups.where(F.col("size") > whole.size / shards).orderBy(F.desc("size"), "h").limit(shards).collect()
    own, left, rest = [], whole.size, shards
    for g in large:
        if rest > 1 and g.size * rest > left:
            own.append(g.h)
            left, rest = left - g.size, rest - 1
    _, starts = minimax_cuts(groups.where(~F.col("h").isin(own)) if own else groups, rest)

    in_run: Column = F.lit(len(own) - 1)
    for start in starts:
        in_run = in_run + (F.col("h") >= F.lit(start)).cast("int")
    number: Column = in_run if starts else F.lit(0)
    for k, h in enumerate(own):
        number = F.when(F.col("h") == F.lit(h), F.lit(k)).otherwise(number)
    least, most = SLOT_BUCKETS
    buckets = min(most, max(least, -(-(whole.n or 0) // (shards * ROWS_A_SLOT_BUCKET))))
    placed = rows.withColumn("shard", number.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).cast("int")
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "crc")
    # shards * buckets rows at most
    return placed.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
