"""Features of texts, sequences, panels, series and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmers(text: Column, k: int) -> Column:
    """Every k consecutive characters; none of a shorter text."""
    # one pass: a character is taken, with what stands from it on; substr would seek each place from the start
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)), F.array().cast("array<string>"))


def kmer_counts(df: DataFrame, keys: list[str], text: str, k: int) -> DataFrame:
    """keys, kmer, n, share, with U read as T."""
    grams = df.select(*keys, F.explode(kmers(F.replace(F.upper(text), F.lit("U"), F.lit("T")), k)).alias("kmer"))
    counts = grams.groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return counts.join(whole, keys).select(*keys, "kmer", "n", (F.col("n") / F.col("_all")).alias("share"))


def fraction(text: Column, letters: str) -> Column:
    """The share of characters that are one of these; null of an empty text."""
    rest = F.translate(text, letters, "")
    return F.try_divide((F.length(text) - F.length(rest)).cast("double"), F.length(text).cast("double"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in nats, largest share, distinct values and rows of a column."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.log("n")).alias("nl"), F.max("n").alias("top"), F.count("*").alias("n_distinct"))
    return sums.select(*keys, (F.log("rows") - F.col("nl") / F.col("rows")).alias("entropy"), (F.col("top") / F.col("rows")).alias("max_share"), "n_distinct", "rows")


def panel(text: Column) -> Column:
    """key:value pairs, separated by spaces, as a map of numbers."""
    return F.transform_values(F.str_to_map(text, F.lit(" "), F.lit(":")), lambda _, v: v.try_cast("double"))


def series(text: Column, separator: str = " ") -> Column:
    """The numbers of a series; what isn't one is null."""
    return F.transform(F.split(text, separator), lambda x: x.try_cast("double"))


def histogram(x: Column, low: float, high: float, bins: int, closed: bool = True) -> Column:
    """The bin of x; the last one includes ``high`` if closed.  Null outside."""
    b = F.floor((x - low) / ((high - low) / bins))
    inside = F.when((x >= low) & (x < high), b)
    return F.coalesce(inside, F.when(x == high, bins - 1)) if closed else inside


def formula_fractions(text: Column) -> Column:
    """Element counts written ``El: n``, as shares of their sum."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?):\s*(\d+\.?\d*)"), F.lit(1))
    counts = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?):\s*(\d+\.?\d*)"), F.lit(2)), lambda x: x.cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.map_from_arrays(names, F.transform(counts, lambda x: x / total))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def vector_text(v: Column, form: str = "%.3f") -> Column:
    return F.array_join(F.transform(v, lambda x: F.format_string(form, x.cast("double"))), " ")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
