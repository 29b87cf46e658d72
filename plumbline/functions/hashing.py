"""Portable pseudo-randomness: the same numbers in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def text(*parts) -> Column:
    """The parts joined by colons; plain values are literals."""
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def md5_number(*parts) -> Column:
    """The first 32 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(text(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1)."""
    return md5_number(*parts) / F.lit(TWO_32)


def shuffle_key(seed, *parts) -> Column:
    """Ordering by this shuffles."""
    return F.md5(text(seed, *parts))
