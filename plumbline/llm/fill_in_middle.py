"""Fill-in-the-middle transformation by run-length encoded character classes.

A text is cut into prefix, middle and suffix by numbers of code points, but stored as UTF-8, where a code point has one
to four bytes: that number is its class.  A text is kept as maximal runs of one class, each with the code points and the
bytes before it.  A cut is found by a binary search for its run; its byte offset within the run is a product.  So a text
is looked at once, as a numpy array, and no code point is handled on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 22

# bytes of the code point that a byte begins; 0 for those within one
_WIDTH = np.ones(256, np.uint8)
_WIDTH[0x80:0xC0] = 0
_WIDTH[0xC0:0xE0] = 2
_WIDTH[0xE0:0xF0] = 3
_WIDTH[0xF0:] = 4


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        """Outputs can be taken apart again only if no sentinel can appear where two strings meet."""
        names = self.all
        if not all(names) or len(set(names)) < 3:
            raise ValueError("three different sentinels that aren't empty are needed")
        for a in names:
            for b in names:
                if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"the sentinels {a} and {b} overlap")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Runs:
    """The maximal runs of code points of one width; both sums have the whole text at their end."""

    units: np.ndarray  # code points before each run
    offset: np.ndarray  # bytes before each run
    width: np.ndarray

    def at(self, cut: int) -> int:
        """The byte offset behind so many code points."""
        if cut >= self.units[-1]:
            return int(self.offset[-1])
        run = int(np.searchsorted(self.units, cut, "right")) - 1
        return int(self.offset[run] + (cut - self.units[run]) * int(self.width[run]))


def encoded_runs(data: bytes | memoryview) -> Runs:
    """The runs of a valid UTF-8 text, found piece by piece, so that memory beside the text is bounded by its runs."""
    counts, widths = [], []
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), PIECE_BYTES):
        lead = _WIDTH[whole[start : start + PIECE_BYTES]]
        lead = lead[lead > 0]
        if not len(lead):
            continue
        edge = np.flatnonzero(np.diff(lead)) + 1
        first = np.concatenate(([0], edge))
        counts.append(np.diff(first, append=len(lead)))
        widths.append(lead[first])
    if not counts:
        return Runs(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8))
    count, width = np.concatenate(counts), np.concatenate(widths)
    new = np.flatnonzero(np.diff(width, prepend=0))  # a run may go on in the next piece
    count, width = np.add.reduceat(count, new), width[new]
    return Runs(np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * width.astype(np.int64)))), width)


def arranged(text: bytes, form: str, low: int, high: int, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text with its middle, from code point low to high, put last."""
    if form == "plain":
        return text
    runs = encoded_runs(text)
    a, b = runs.at(low), runs.at(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _draws(seed: str, key: Column) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1, drawn by the seed and a row's id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    *,
    seed: str = "1",
    percent: int = 90,
    spm_percent: int = 20,
    sentinels: Sentinels = Sentinels(),  # noqa: B008  immutable
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row's id, n (code points), form, prefix_chars, middle_chars and output.

    So many percent of texts are cut at two places drawn by seed and id; of those, ``spm_percent`` get the form spm, with
    the suffix first, and others psm.  Empty and null texts, and texts that hold a sentinel, are plain: output is the text,
    and the two lengths are null.  Rows are independent, so repeated ids with one text give one output.  Other columns
    aren't kept, so their names can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = _draws(seed, F.col(id_col))
    n = F.char_length(text).cast("long")
    held = F.lit(False)
    for mark in sentinels.all:
        held = held | F.contains(text, F.lit(mark))
    form = F.when((text == "") | held | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    dealt = docs.select(F.col(id_col).alias("id"), text.alias("text"), n.alias("n"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    dealt = dealt.select("id", "text", "n", "form", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    marks = tuple(m.encode() for m in sentinels.all)

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = zip(texts, *(batch.column(c).to_pylist() for c in ("form", "low", "high")), strict=True)
            done = [arranged(t.as_py(), form, low, high, marks) for t, form, low, high in rows]
            kept = [batch.column(c) for c in ("id", "n", "form", "low", "high")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(done, pa.binary()).cast(pa.string())], ["id", "n", "form", "low", "high", "output"])

    names = dealt.select("id", "n", "form", "low", "high", F.col("text").alias("output"))
    made = dealt.mapInArrow(cut_batches, names.schema)
    shown = F.col("form") != "plain"
    return made.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.when(shown, F.col("low")).alias("prefix_chars"),
        F.when(shown, F.col("high") - F.col("low")).alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:  # noqa: B008  immutable
    """The text that ``output`` was made from; each sentinel stands in it once."""
    marks = "|".join(re.escape(m) for m in sentinels.all)
    part = F.split(output, marks, -1)  # what precedes the first sentinel is empty
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
