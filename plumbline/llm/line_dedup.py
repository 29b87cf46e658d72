"""Removal of repeated passages by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the last ROLL line hashes ends a chunk where it is divisible by
DIVISOR and the chunk is worth removing.  A line of LONG_LINE words or more is a passage of its own, with a boundary
on either side.  These chunks cover a text, but a short passage may hold none of them whole.  So a second set is
chosen: from every line with words there is a shortest run worth removing, and of those within the next WINDOW_WORDS words, or
WINDOW_LINES lines, the one of least hash is a chunk too.  A shared run of lines with as many words or lines therefore
holds the same whole chunk wherever it stands.  Of every chunk that occurs more than once, and has several lines or a
long one, all but the first occurrence are removed, after their bytes have been compared with the first one's.  Up to
EXTEND shorter lines on either side go too where they are those of the first occurrence, since a chunk rarely ends
where a passage does.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import written

ROLL = 2
DIVISOR = 3
LONG_LINE = 20
LEAST_WORDS = 12  # of a chunk that is worth removing
MOST_LINES = 64
WINDOW_WORDS = 50
WINDOW_LINES = 10
EXTEND = WINDOW_LINES - 2  # a window's chunk has no more lines beside it

_STEP, _ALL = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF

BROADCAST_IDS = 4_000_000  # of documents whose texts are read again, some 64 MB; more are shuffled with the texts
LEAST_SHARE, MOST_SHARES = 50_000, 2_000  # of a chunk's occurrences that meet in one task: a MOST_SHARES-th of all, or LEAST_SHARE

FIRST = ("chunk", "before", "after")  # of a chunk's first occurrence
CHUNK_ROW = "id long, line int, lines int, k1 long, k2 long"


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, lines) of consecutive chunks that cover all lines.  None ends before it is worth removing, but for
    one before a long line and the last."""
    out, first, words, rolled = [], 0, 0, [0] * ROLL
    for i, line in enumerate(lines):
        own = len(line.split(None, LONG_LINE))
        if own >= LONG_LINE and i > first:
            out.append((first, i - first))
            first, words = i, 0
        words += own
        rolled = [*rolled[1:], xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))]
        mixed = 0
        for h in rolled:
            mixed = (mixed * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        worth = _worth(i + 1 - first, words)
        if own >= LONG_LINE or worth and (mixed >> 16) % DIVISOR == 0 or i + 1 - first == MOST_LINES:
            out.append((first, i + 1 - first))
            first, words = i + 1, 0
            rolled = [0] * ROLL if own >= LONG_LINE else rolled
    if first < len(lines):
        out.append((first, len(lines) - first))
    return out


def _worth(lines: int, words: int) -> bool:
    """Several lines or a long one, and not few words."""
    return words >= LONG_LINE or lines > 1 and words >= LEAST_WORDS


def chosen(lines: list[str]) -> set[tuple[int, int]]:
    """(first line, lines) of the shortest worthy runs that have the least hash of a window of lines.

    Runs and windows begin at lines with words.  A window goes on to where it has WINDOW_WORDS words, or WINDOW_LINES lines
    and a worthy run, and no further; a text with less is one window.  A run's hash is of its lines alone, taken from sums
    over the lines before its ends, and a queue keeps a window's least, so time is in proportion to the lines.
    """
    words = [len(line.split(None, LONG_LINE)) for line in lines]
    sums = [0]  # of hashes, each line's multiplied once more for every line behind it
    powers = [1]
    for line in lines:
        sums.append((sums[-1] * _STEP + xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))) & _ALL)
        powers.append(powers[-1] * _STEP & _ALL)
    starts = [i for i, n in enumerate(words) if n]
    ends, rank, at, total = [], [], 0, 0  # of the run from each start; the last ones have none
    for i in starts:
        at, total = (i, 0) if at < i else (at, total)
        while at < len(lines) and not _worth(at - i, total):
            total += words[at]
            at += 1
        if not _worth(at - i, total):
            break
        ends.append(at)
        total -= words[i]
        mixed = (sums[at] - sums[i] * powers[at - i]) * _STEP & _ALL
        rank.append(mixed ^ mixed >> 29)
    out, at, total, behind, waiting = set(), 0, 0, 0, deque()
    for k, (i, end) in enumerate(zip(starts, ends, strict=False)):
        at, total = (i, 0) if at < i else (at, total)
        while at < len(lines) and (at < end or total < WINDOW_WORDS and at - i < WINDOW_LINES):
            total += words[at]
            at += 1
        if k and total < WINDOW_WORDS and at - i < WINDOW_LINES:
            break  # the text ends in this window and all later ones
        behind = max(behind, k)
        while behind < len(ends) and ends[behind] <= at:
            while waiting and rank[waiting[-1]] > rank[behind]:
                waiting.pop()
            waiting.append(behind)
            behind += 1
        while waiting[0] < k:
            waiting.popleft()
        best = waiting[0]
        out.add((starts[best], ends[best] - starts[best]))
        total -= words[i]
    return out


def removable(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """First line, lines and text of the chunks that may be removed: several lines or a long one, and not few words."""
    for first, n in sorted({*chunks(lines), *chosen(lines)}):
        text = "\n".join(lines[first : first + n])
        words = len(text.split(None, LONG_LINE))
        if _worth(n, words):
            yield first, n, text


def _digest(text: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(text.encode("utf-8", "replace"))
    return tuple((x ^ 1 << 63) - (1 << 63) for x in (d >> 64, d & 0xFFFFFFFFFFFFFFFF))


def _short(lines: list[str]) -> list[str]:
    """The first lines of these up to a long one, EXTEND at most."""
    out = []
    for line in lines[:EXTEND]:
        if len(line.split(None, LONG_LINE)) >= LONG_LINE:
            break
        out.append(line)
    return out


def beside(lines: list[str], first: int, n: int) -> tuple[list[str], list[str]]:
    """The short lines before a chunk, nearest first, and after it."""
    return _short(lines[max(0, first - EXTEND) : first][::-1]), _short(lines[first + n :])


def _chunk_rows(with_text: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                lines = text.split("\n")
                for first, n, chunk in removable(lines):
                    row = (doc, first, n, *_digest(chunk))
                    out.append((*row, chunk, *beside(lines, first, n)) if with_text else row)
            names = ["id", "line", "lines", "k1", "k2", "chunk", "before", "after"][: 8 if with_text else 5]
            yield pd.DataFrame(out, columns=names).astype({k: "int64" for k in names[:5]})

    return rows


REMOVED_ROW = "text string, n_lines long, n_removed_lines long, n_removed_words long"


def _same(here: list[str], there) -> int:
    return next((k for k, (a, b) in enumerate(zip(here, there, strict=False)) if a != b), min(len(here), len(there)))


def _cut(text: str, spans: list) -> tuple[str, int, int, int]:
    lines = text.split("\n")
    gone: set[int] = set()
    for s in spans:
        first, n = s["line"], s["lines"]
        if "\n".join(lines[first : first + n]) == s["chunk"]:
            before, after = beside(lines, first, n)
            gone.update(range(first - _same(before, s["before"]), first + n + _same(after, s["after"])))
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return "\n".join(kept), len(lines), len(gone), sum(len(lines[i].split()) for i in gone)


def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Each text without its spans whose bytes are those of the chunk they repeat."""
    rows = [_cut(t, s) if t is not None and s is not None and len(s) else (t, t.count("\n") + 1 if t is not None else 0, 0, 0) for t, s in zip(texts, spans, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed_lines", "n_removed_words"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """id, line, lines, and chunk, before and after: every occurrence but the first of a chunk, with the text and surroundings of the first one.

    docs: id, text, neither null.  First means of smallest id, then line.
    """
    rows = written(docs.mapInPandas(_chunk_rows(False), CHUNK_ROW), "chunks")
    at = F.struct("id", "line")
    repeated = written(rows.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1"), "chunks-repeated")
    # occurrences of a chunk that has more than its share are dealt to several copies of the first one
    share = max(LEAST_SHARE, rows.count() // MOST_SHARES)
    hot = F.broadcast(repeated.where(F.col("n") > share).select("k1", "k2", F.ceil(F.col("n") / share).cast("int").alias("deals")))  # MOST_SHARES rows at most
    # the text of each first occurrence: the documents that have one are read again
    wanted = repeated.select(F.col("first.id").alias("id"), F.col("first.line").alias("line"), "k1", "k2")
    ids = written(wanted.select("id").distinct(), "chunks-wanted")
    source = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    texts = source.mapInPandas(
        _chunk_rows(True), f"{CHUNK_ROW}, chunk string, before array<string>, after array<string>"
    ).join(wanted, ["id", "line", "k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in FIRST])
    first = written(repeated.drop("n").join(texts, ["k1", "k2"]), "chunks-first")
    deal = F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))
    first = first.join(hot, ["k1", "k2"], "left").withColumn("deal", deal).drop("deals")
    rows = rows.join(hot, ["k1", "k2"], "left").withColumn("deal", F.pmod(F.xxhash64("id", "line"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    # a run that begins within its own first occurrence, as among equal lines, isn't another one
    other = (F.col("id") != F.col("first.id")) | (F.col("line") >= F.col("first.line") + F.col("lines"))
    return rows.join(first, ["k1", "k2", "deal"]).where(other).select("id", "line", "lines", *FIRST)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its own columns, ``text_col`` without repeated chunks, and what was removed.

    Added: n_lines, n_removed_lines and n_removed_words.  Lines end at a line feed.  A text whose chunks all occur
    earlier becomes empty; rows are never dropped.  A null text stays null.  Rows without an id stay as they are.
    Rows that repeat an id and a text are one document, and all of them keep what it keeps.  Columns of ``docs``
    named like the added ones are replaced.
    """
    added = ("n_lines", "n_removed_lines", "n_removed_words")
    own = [c for c in docs.columns if c not in added]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    span = F.struct("line", "lines", *FIRST)
    without = F.pandas_udf(_without, REMOVED_ROW)
    spans = repeated_chunks(plain).groupBy("id").agg(F.collect_list(span).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = rows.join(spans, "id", "left").select("row", without("text", "spans").alias("cut"))
    return cut.select(*[F.col("cut.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own], *[f"cut.{c}" for c in added])


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their own columns, and texts without repeated chunks; n_chars, if there is one, follows.

    A document that loses all its words goes, since nothing of it is its own; one that had none stays.
    """
    done = line_dedup(docs, id_col=id_col, text_col=text_col)
    done = done.where((F.col("n_removed_words") == 0) | F.col(text_col).rlike(r"\S"))
    if "n_chars" in docs.columns:
        own = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, own).otherwise(F.col("n_chars")))
    return done.select(docs.columns)
