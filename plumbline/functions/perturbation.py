"""Seeded changes of texts that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.hashing import text as joined


def scramble(text: Column, *seed) -> Column:
    """The characters of a text in the order of their positions' hashes."""
    pieces = F.transform(F.split(text, ""), lambda c, i: F.struct(F.md5(joined(*seed, i)).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(F.filter(pieces, lambda p: p["c"] != "")), lambda p: p["c"]), "")


def scramble_different(text: Column, *seed, tries: int = 8) -> Column:
    """The first of some scrambles that differs from the text, or the text."""
    return F.coalesce(*[F.nullif(scramble(text, *seed, k), text) for k in range(tries)], text)


def fake_accession(text: Column, *seed, kept: int = 2) -> Column:
    """The head kept, the tail scrambled, or reversed if that changes nothing."""
    head, tail = F.substr(text, F.lit(1), F.lit(kept)), F.substr(text, F.lit(kept + 1))
    mixed = scramble(tail, *seed)
    return F.concat(head, F.when(mixed == tail, F.reverse(tail)).otherwise(mixed))


def anonymized(text: Column, patterns: list[str]) -> Column:
    """The text without these patterns; as it was if nothing is left."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), text)


def window_around(text: Column, position: Column, radius: int) -> Column:
    """The text from radius before a position (from 1) to radius after it, as far as it goes."""
    low = F.greatest(F.lit(1), position - radius)
    return F.substr(text, low, F.least(F.length(text), position + radius) - low + 1)
