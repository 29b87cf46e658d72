"""Source divergence audit: how far each source of a language is from its other sources, and by which terms.

Terms of each language are those in at least ``min_docs`` of its documents.  A group, that is a source within a language,
gives each term a smoothed probability in billionths, and so does the language as a whole.

Terms are searched by upper bounds.  A group's terms go into buckets by their count there; a bucket's largest count and
its smallest count in the language bound the excess of every term in it.  Buckets are taken from the largest bound on
until they hold ``top`` terms; then all those whose bound isn't below the last of the best terms so far.  Only their terms
are evaluated and sorted; no other one can be among the best, ties included.

Pairs of groups are compared from postings.  A term that a group lacks has the group's floor, so a pair's sum over all
terms follows from its floors, the sums of each group and the terms that both have; counts below the other's floor, again
by buckets, are corrected for.  So only terms that both sources have are met pair by pair, and added up where they are met.

All numbers are whole: probabilities by division of decimals, the rest longs.  All of it is built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import written

BILLION = 1_000_000_000
SMOOTH = 5
GROUPS_A_BLOCK = 1000
BROADCAST_GROUPS = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_GROUP = ["lang", "source"]


def terms(text: Column) -> Column:
    """Runs of a-z and characters beyond ASCII, after lower-casing A-Z; none of null."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(BILLION * (count + SMOOTH) / (total + SMOOTH * terms)), exactly; null where there are no terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", F.lit(BILLION).cast("decimal(10,0)") * whole(count + SMOOTH), whole(total + SMOOTH * terms))
    return F.when(terms > 0, 1 + share)


def bucket(count: Column) -> Column:
    """The bucket of a count: exact below 64, then sixteen for each doubling, so a group has some hundreds at most."""
    return F.when(count < 64, count).otherwise(64 + F.floor(16 * F.log2(count / 64))).cast("int")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), docs (documents that have it) of rows lang, source, text."""
    worded = docs.select(*_GROUP, terms(F.col("text")).alias("w"))
    both = F.array(F.struct(F.col("w"), F.lit(1).alias("c"), F.lit(0).alias("docs")), F.struct(F.array_distinct("w").alias("w"), F.lit(0).alias("c"), F.lit(1).alias("docs")))
    each = worded.select(*_GROUP, F.inline(both)).select(*_GROUP, "c", "docs", F.explode("w").alias("term"))
    return each.groupBy(*_GROUP, "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def _beside(left: DataFrame, groups: DataFrame, n_groups: int, when: Column) -> DataFrame:
    """left with each group of its lang (columns other, floor_o ...) that meets the condition.

    Few groups are broadcast; many are dealt to blocks, to each of which a row of left goes, so no task has all groups of
    a language.
    """
    if n_groups <= BROADCAST_GROUPS:
        return left.join(F.broadcast(groups), (left["lang"] == groups["lang_o"]) & when)
    blocks = -(-n_groups // GROUPS_A_BLOCK)
    dealt = groups.withColumn("block_o", F.pmod(F.xxhash64("other"), F.lit(blocks)))
    copied = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return copied.join(dealt, (F.col("lang") == F.col("lang_o")) & (F.col("block") == F.col("block_o")) & when)


def pair_values(posts: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """lang, source, item, value: the sum of differences over all terms, for every two sources of a language."""
    own = groups.select(*_GROUP, "floor", "v", "n_terms", "sum_p")
    other = groups.select(F.col("lang").alias("lang_o"), F.col("source").alias("other"), F.col("floor").alias("floor_o"), F.col("n_terms").alias("n_terms_o"), F.col("sum_p").alias("sum_p_o"))
    apart = F.abs(F.col("floor") - F.col("floor_o"))
    # as if no count were below the other's floor and no term were in both
    alone = F.col("sum_p") - F.col("n_terms") * (F.col("floor_o") + apart) + F.col("sum_p_o") - F.col("n_terms_o") * (F.col("floor") + apart)
    base = _beside(own, other, n_groups, F.col("source") < F.col("other"))
    base = base.select("lang", F.col("source").alias("s"), F.col("other").alias("r"), F.coalesce(F.col("v") * apart + alone, F.lit(0)).alias("value"))
    buckets = posts.groupBy(*_GROUP, "p").agg(F.count("*").alias("m"))
    lower = _beside(buckets, other.select("lang_o", "other", "floor_o"), n_groups, (F.col("source") != F.col("other")) & (F.col("p") < F.col("floor_o")))
    lower = lower.select("lang", F.least("source", "other").alias("s"), F.greatest("source", "other").alias("r"), (2 * F.col("m") * (F.col("floor_o") - F.col("p"))).alias("value"))
    mine = posts.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("x"), F.col("floor").alias("a"))
    theirs = posts.select("lang", "term", F.col("source").alias("r"), F.col("p").alias("y"), F.col("floor").alias("b"))
    both = mine.join(theirs, ["lang", "term"]).where("s < r")
    x, y, a, b = (F.col(k) for k in "xyab")
    both = both.select("lang", "s", "r", (F.abs(x - y) - F.abs(x - b) - F.abs(a - y) + F.abs(a - b)).alias("value"))
    summed = reduce(DataFrame.unionByName, [base, lower, both.groupBy("lang", "s", "r").agg(F.sum("value").alias("value"))])
    summed = summed.groupBy("lang", "s", "r").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("s").alias("source"), F.col("r").alias("item")), F.struct(F.col("r").alias("source"), F.col("s").alias("item")))
    return summed.select("lang", "value", F.inline(ways)).select(*_GROUP, "item", "value")


def _best(df: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each group, by value, then by item; tasks cut their groups before the shuffle."""
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _evaluated(posts: DataFrame, buckets: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms in these buckets that exceed their language."""
    chosen = posts.join(buckets.select(*_GROUP, "bucket"), [*_GROUP, "bucket"])
    q = probability(F.col("lang_c"), F.col("lang_n"), F.col("v"))
    return chosen.select(*_GROUP, F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")


def best_terms(posts: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the ``top`` terms of each group that exceed their language most."""
    sums = posts.groupBy(*_GROUP, "bucket").agg(F.count("*").alias("m"), F.max("p").alias("most"), F.min("lang_c").alias("least"), F.first("lang_n").alias("lang_n"), F.first("v").alias("v"))
    bounds = sums.select(*_GROUP, "bucket", "m", (F.col("most") - probability(F.col("least"), F.col("lang_n"), F.col("v"))).alias("bound")).where("bound > 0")
    before = Window.partitionBy(*_GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ordered = written(bounds.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))), "audit-buckets", tasks=8)
    first = written(_best(_evaluated(posts, ordered.where(F.col("before") < top)), top).drop("rank"), "audit-first", tasks=8)
    last = first.groupBy(*_GROUP).agg(F.when(F.count("*") >= top, F.min("value")).alias("last"))
    open_still = ordered.where(F.col("before") >= top).join(last, _GROUP, "left").where(F.col("bound") >= F.coalesce("last", F.lit(1)))
    return _best(first.unionByName(_evaluated(posts, open_still)), top)


def divergence_audit(docs: DataFrame, min_docs: int = 30, top: int = 50, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank, of every (lang, source) that occurs.

    Part ``pair``: each other source of the lang, by the sum of differences of probability over its kept terms (0 if it has
    none), all ranks.  Part ``term``: the ``top`` kept terms that the group has and that are likelier there than in the
    lang, by the difference.  Ranks go by falling value, then by item in the order of its UTF-8 bytes.  Null lang, source
    and text are the empty string.  Every row is a document, so repeated rows count as often.  No documents give no rows.
    Other columns are ignored, so their names can't clash.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text"))
    counts = written(term_counts(rows), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    found = written(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "audit-found")
    langs = found.select("lang", "term", "lang_c").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_c").alias("lang_n"))
    sums = found.groupBy(*_GROUP).agg(F.sum("c").alias("n"))
    groups = rows.select(*_GROUP).distinct().join(sums, _GROUP, "left").join(langs, "lang", "left").na.fill(0, ["n", "v"])
    groups = written(groups.withColumn("floor", probability(F.lit(0), F.col("n"), F.col("v"))), "audit-groups", tasks=8)
    n_groups = groups.count()
    posts = found.join(groups, _GROUP).withColumns({"p": probability(F.col("c"), F.col("n"), F.col("v")), "bucket": bucket(F.col("c"))})
    posts = written(posts.drop("n"), "audit-postings")
    held = posts.groupBy(*_GROUP).agg(F.count("*").alias("n_terms"), F.sum("p").alias("sum_p"))
    groups = written(groups.join(held, _GROUP, "left").na.fill(0, ["n_terms", "sum_p"]), "audit-sums", tasks=8)
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    pairs = pair_values(posts, groups, n_groups).withColumn("rank", F.row_number().over(order))
    parts = [df.select(*_GROUP, F.lit(name).alias("part"), "item", "value", "rank") for name, df in (("pair", pairs), ("term", best_terms(posts, top)))]
    return parts[0].unionByName(parts[1])
