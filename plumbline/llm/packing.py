"""Packing token sequences: large-item matching, then best fit.

Items are documents, or pieces of those longer than a sequence.  What fits together depends on lengths alone, so
the plan is made from the number of items of each length: at most ``capacity`` numbers, whatever the corpus.

* Items above a third of the capacity are large: at most two of them share a sequence.  From the longest down,
  each takes the longest partner that still fits.
* Smaller items, from the longest down, go where the least room is left over, and open new sequences only when
  none has room.

The plan places runs of equally long items into runs of sequences.  Items of a length are numbered across the
cluster, and each finds its run by bisection.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.pretokenize import PATTERN, SPECIAL
from plumbline.llm.storage import written
from plumbline.llm.token_counts import byte_symbols

CACHED_CHUNKS, CACHED_IDS = 300_000, 4_000_000


# A space before anything else but white space starts a piece, whatever stands around it.
_other_space = re.compile(r" (?:\s|\Z)")


class ChunkIds(dict):
    """A number for every chunk of text after a space, given when first asked for; forgets all when full.

    tiktoken splits and merges the chunks, with the vocabulary of the tokenizers file; it gives the same ids in a
    fraction of the time.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if t not in special}
        self.encode = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = special[SPECIAL]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self.ends) - 1
        self.ids.extend(self.encode(" " + chunk))
        self.ends.append(len(self.ids))
        return at

    def part(self, text: str) -> np.ndarray:
        if _other_space.search(text):
            return np.array(self.encode(text), np.uint32)
        first, *chunks = text.split(" ")
        begin = np.array(self.encode(first), np.uint32)
        if not chunks:
            return begin
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        ends = np.frombuffer(self.ends, np.int64)
        start = ends[at]
        length = ends[at + 1] - start
        stop = np.cumsum(length)
        return np.concatenate([begin, np.frombuffer(self.ids, np.uint32)[np.repeat(start - (stop - length), length) + np.arange(stop[-1])]])

    def of(self, text: str) -> np.ndarray:
        """The ids of a text, as the tokenizer gives them without added special tokens."""
        if len(self) >= CACHED_CHUNKS or len(self.ids) >= CACHED_IDS:
            self.forget()
        out = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(np.array([self.special], np.uint32))
            if part:
                out.append(self.part(part))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """Kept by the worker process from one task to the next."""
    return ChunkIds(path)


ITEMS = "id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The items: id, piece, start, length, ids_crc32.  The first piece of a long document takes what is left over."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                tokens = np.append(ids.of(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                at, piece = 0, 0
                while at < len(tokens):
                    n = (len(tokens) - 1) % capacity + 1 if at == 0 else capacity
                    rows.append((doc, piece, at, n, zlib.crc32(tokens[at : at + n].tobytes())))
                    at, piece = at + n, piece + 1
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            out["id"] = out["id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, ITEMS)


def plan(count: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where items go: rows of (length, first number, items, first sequence, offset), and the sequences used.

    count: number of items by length, from 1 to capacity.
    """
    left = {n: c for n, c in count.items() if c}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of (first sequence, sequences)
    used = 0

    def put(length: int, items: int, sequence: int, offset: int) -> None:
        rows.append((length, taken[length], items, sequence, offset))
        taken[length] += items
        left[length] -= items

    for length in sorted((n for n in left if 3 * n > capacity), reverse=True):
        while left[length]:
            partner = next((n for n in sorted(left, reverse=True) if 3 * n > capacity and n + length <= capacity and left[n] > (n == length)), None)
            if partner is None:
                k, free = left[length], capacity - length
                put(length, k, used, 0)
            else:
                k = left[length] // 2 if partner == length else min(left[length], left[partner])
                free = capacity - length - partner
                put(length, k, used, 0)
                put(partner, k, used, length)
            room.setdefault(free, []).append((used, k))
            used += k
    room.pop(0, None)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            free = min((g for g in room if g >= length), default=None)
            if free is None:
                each = min(capacity // length, left[length])
                k = left[length] // each
                for j in range(each):
                    put(length, k, used, j * length)
                if capacity - each * length:
                    room.setdefault(capacity - each * length, []).append((used, k))
                used += k
                continue
            first, run = room[free].pop()
            k = min(run, left[length])
            put(length, k, first, capacity - free)
            if k < run:
                room[free].append((first + k, run - k))
            if not room[free]:
                del room[free]
            if free > length:
                room.setdefault(free - length, []).append((first, k))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, used


def numbered(items: DataFrame, count: dict[int, int]) -> DataFrame:
    """The items with ``number``: from 0 without a gap among those of equal length.

    Lengths that many items share are split, so that no task numbers more than its share of all items.
    """
    spark = items.sparkSession
    share = max(1, sum(count.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = spark.createDataFrame([(n, -(-c // share)) for n, c in count.items()], "length long, parts int")
    dealt = items.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("parts")).cast("int"))
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    # at most capacity + 4 * partitions rows
    return dealt.join(F.broadcast(offsets), ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("offset") + F.row_number().over(within) - 1).cast("long").alias("number")
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text, then ``end_id``.  Only documents longer than ``capacity`` are cut.  A null
    text counts as empty, so its document is one token long.  Repeated rows are packed as often as they occur.  An
    empty table gives an empty result.
    """
    items = written(cut_documents(docs, vocabulary, capacity, end_id, id_col, text_col), "pack-items")
    # one row per length, so at most `capacity`
    count = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, used = plan(count, capacity)
    places = items.sparkSession.sparkContext.broadcast(table)
    key = table[:, 0] << 48 | table[:, 1] if len(table) else None
    keys = items.sparkSession.sparkContext.broadcast(key)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, number = batch["length"].to_numpy(np.int64), batch.pop("number").to_numpy(np.int64)
            row = places.value[np.searchsorted(keys.value, length << 48 | number, "right") - 1]
            batch["sequence_id"] = row[:, 3] + number - row[:, 1]
            batch["offset"] = row[:, 4]
            yield batch

    placed = numbered(items, count).mapInPandas(place, f"{ITEMS}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
