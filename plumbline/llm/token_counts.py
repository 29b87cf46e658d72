"""Token counts by byte-pair merging, without making identifiers.

A piece of text starts as one symbol per byte.  The adjacent pair of lowest rank is merged, again and again, until
no pair has a rank; each merge leaves one symbol fewer.  Pairs wait in a heap, symbols form a linked list, so a
piece of n bytes takes O(n log n) steps however long it is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pretokenize import SPECIAL, pieces

CACHED_PIECES = 400_000
CACHED_LENGTH = 64  # longer pieces are rarely met again


def byte_symbols() -> list[str]:
    """The printable character by which vocabulary files write each byte: itself, or the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class PieceCounter(dict):
    """Number of tokens by piece, computed when first asked for; forgets all when full."""

    def __init__(self, merges: list, most: int = CACHED_PIECES):
        super().__init__()
        self.most = most
        number = {s: i for i, s in enumerate(byte_symbols())}
        self.first = list(range(256))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged = number.setdefault(left + right, len(number))
            self.rank[number[left], number[right]] = (rank, merged)

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        symbol: list[int] = list(data)
        n, rank = len(symbol), self.rank
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := rank.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two went into another merge
            merges += 1
            symbol[i], symbol[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((merged, symbol[k])):
                    heapq.heappush(heap, (found[0], i, merged, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := rank.get((symbol[h], merged))):
                heapq.heappush(heap, (found[0], h, symbol[h], merged, found[1]))
        return n - merges


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """Kept by the worker process from one task to the next."""
    with open(path, encoding="utf-8") as f:
        return PieceCounter(json.load(f)["model"]["merges"])


def count_text(text: str, of: PieceCounter) -> int:
    parts = text.split(SPECIAL)
    return len(parts) - 1 + sum(sum(map(of.__getitem__, pieces(p))) for p in parts if p)


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 1024,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    vocabulary: a byte-level tokenizers file that every executor can read.  The special token's string counts as
    one token wherever it stands.  A null or empty text has none.  Rows are kept as they are, repeated ids too.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        of = counter(vocabulary)
        return texts.map(lambda t: count_text(t, of) if t else 0).astype("int64")

    text = F.col(text_col)
    counted = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        tokens(text).alias("n_tokens"),
    )
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
