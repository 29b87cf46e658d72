"""Reading values out of answer texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d*\.?\d+"
SIGNED = r"-?\d*\.?\d+"


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    """Every number of a text, in order; none of null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))


def _as_probability(x: Column) -> Column:
    return F.when(x > 1.0, x / 100).otherwise(x)


def probability(text: Column, last: bool = True, default: float = 0.5) -> Column:
    """The last (or first) number up to 100, those over 1 taken as percent; signs are ignored."""
    fit = F.filter(numbers(text), lambda x: x <= 100.0)
    return F.coalesce(_as_probability(F.get(F.reverse(fit) if last else fit, 0)), F.lit(default))


def probability_kind(text: Column) -> Column:
    """parsed, percent or fallback: how ``probability`` came by its value."""
    x = F.get(F.reverse(F.filter(numbers(text), lambda x: x <= 100.0)), 0)
    return F.when(x.isNull(), "fallback").when(x > 1.0, "percent").otherwise("parsed")


def stated(text: Column, name: str) -> Column:
    """The number after ``name:``, in any case, not clamped; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?i){name}\s*:\s*([01]?\.?\d+)", 1), F.lit("")).try_cast("double")


def route(text: Column) -> Column:
    """DEFER if the word is anywhere, else SELF."""
    return F.when(F.coalesce(text.rlike(r"(?i)\bdefer\b"), F.lit(False)), "DEFER").otherwise("SELF")


def number(text: Column) -> Column:
    """The last signed number; null if there is none."""
    return F.get(F.reverse(numbers(text, SIGNED)), 0)


def age(text: Column, default: float = 50.0) -> Column:
    """The first number up to 120."""
    return F.coalesce(F.get(F.filter(numbers(text), lambda x: x <= 120.0), 0), F.lit(default))


def three_numbers(text: Column) -> Column:
    """The first three numbers, or null if there are fewer."""
    found = numbers(text)
    return F.when(F.size(found) >= 3, F.slice(found, 1, 3))


def strings(text: Column) -> Column:
    """The strings of a JSON array in the text, or else whatever stands in double quotes."""
    array = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    return F.coalesce(F.when(F.size(array) > 0, array), quoted)


def markers(text: Column, longest: int = 12) -> Column:
    """Distinct upper-case names of letters, digits and hyphens, from a list split at commas and line ends."""
    parts = F.transform(F.split(text, "[,\n]"), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike("^[A-Z0-9-]+\\z") & (F.length(x) <= longest)))


def recognized(text: Column, names: Column) -> Column:
    """Whether one of these names stands in the text as a word, unless it says UNKNOWN."""
    quoted = lambda n: F.concat(F.lit(r"(?i)\b\Q"), n, F.lit(r"\E\b"))
    return F.exists(names, lambda n: F.regexp_like(text, quoted(n))) & ~text.rlike(r"(?i)\bunknown\b")


def first_token(text: Column) -> Column:
    """The first word of a text without its code fences."""
    bare = F.trim(F.regexp_replace(text, r"```[a-z]*\n?", ""))
    return F.get(F.split(bare, r"\s+"), 0)


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def head_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")
