"""Preparation of items: filters, joins, set operations and windows.

Windows without a partition run over data that an aggregation, a limit or a broadcast has bounded; where they would
run over a whole table, ranks are made by range partition (see ``ranked``).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sequences import kmers
from plumbline.sources.staging import staged


def classed(df: DataFrame, column: str, positive: list[str], negative: list[str], name: str = "label") -> DataFrame:
    """Rows of either class with ``name`` 1 or 0; others are left out."""
    label = F.when(F.col(column).isin(positive), 1).when(F.col(column).isin(negative), 0)
    return df.withColumn(name, label).where(F.col(name).isNotNull())


def stars(df: DataFrame, column: str, exact: Mapping[str, int], prefixes: Mapping[str, int], least: int, name: str = "stars") -> DataFrame:
    """A grade by exact value, else by prefix, else 0; rows below ``least`` are left out."""
    grade = F.lit(0)
    for prefix, n in reversed(prefixes.items()):
        grade = F.when(F.startswith(F.col(column), F.lit(prefix)), n).otherwise(grade)
    for value, n in reversed(exact.items()):
        grade = F.when(F.col(column) == value, n).otherwise(grade)
    return df.withColumn(name, grade).where(F.col(name) >= least)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order; its other columns are those of that row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def median_binarized(df: DataFrame, keys: list[str], value: str, name: str = "label") -> DataFrame:
    """Above the group's median; if that gives one class, above its mean; groups that still have one are left out."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.max(value).alias("_max"), F.min(value).alias("_min"))
    cuts = percentiles(df, keys, value, [0.5], "_p").withColumn("_median", F.col("_p")[0]).join(means, keys)
    by_median = (F.col("_min") <= F.col("_median")) & (F.col("_max") > F.col("_median"))
    by_mean = (F.col("_min") <= F.col("_mean")) & (F.col("_max") > F.col("_mean"))
    cuts = cuts.select(*keys, F.when(by_median, F.col("_median")).when(by_mean, F.col("_mean")).alias("_cut")).where("_cut is not null")
    return df.join(F.broadcast(cuts), keys).withColumn(name, (F.col(value) > F.col("_cut")).cast("int")).drop("_cut")


def tercile_split(df: DataFrame, keys: list[str], value: str, name: str = "label") -> DataFrame:
    """Rows of the lowest and highest third of each group, labelled 0 and 1."""
    cuts = percentiles(df, keys, value, [1 / 3, 2 / 3], "_cut")
    low, high = F.col("_cut")[0], F.col("_cut")[1]
    inside = df.join(F.broadcast(cuts), keys).where((F.col(value) <= low) | (F.col(value) >= high))
    return inside.withColumn(name, (F.col(value) >= high).cast("int")).drop("_cut")


def in_strata(df: DataFrame, strata: Mapping[str, str], name: str = "stratum") -> DataFrame:
    """A row for each stratum that a row is in; strata may overlap."""
    named = F.array(*[F.when(F.expr(p), F.lit(k)) for k, p in strata.items()])
    return df.withColumn(name, F.explode(F.array_compact(named)))


def left_default(df: DataFrame, other: DataFrame, keys: list[str], defaults: Mapping) -> DataFrame:
    """Left join, with these values where nothing matches."""
    joined = df.join(other, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def first_release(ids: DataFrame, releases: Mapping[str, DataFrame], otherwise: str, key: str = "id", name: str = "first_seen") -> DataFrame:
    """The first of these releases, oldest first, that has each id."""
    seen = F.lit(otherwise)
    for k, release in reversed(list(enumerate(releases))):
        flag = f"_in{k}"
        ids = ids.join(releases[release].select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
        seen = F.when(F.col(flag), release).otherwise(seen)
    return ids.select(key, seen.alias(name))


def neighbor_votes(neighbors: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Mean label of the neighbours, and the share of the larger class."""
    y = F.sum(label)
    n = F.count("*")
    return neighbors.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("mean_label"), (F.greatest(y, n - y) / n).alias("purity"))


def diversity(df: DataFrame, order: Column, n: int, bits: str = "bits", key: str = "id") -> DataFrame:
    """One minus the mean Tanimoto similarity over pairs of n rows, the first in this order."""
    drawn = df.select(key, bits).orderBy(order, key).limit(n)
    other = drawn.select(F.col(key).alias("_id"), F.col(bits).alias("_bits"))
    both = F.size(F.array_intersect(bits, "_bits"))
    sim = both / F.size(F.array_union(bits, "_bits"))
    return drawn.join(F.broadcast(other), F.col(key) < F.col("_id")).agg((1 - F.avg(sim)).alias("diversity"))


def novel(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows that aren't known."""
    return found.distinct().join(known.select(*keys), keys, "left_anti")


def power_gate(designs: DataFrame, known: DataFrame, temperatures: list[int], order: Column, n: int) -> DataFrame:
    """A row for each temperature that designs were drawn at: validity, novel_per_1k, diversity of n fresh ones in this order, pass,
    and operating, the highest temperature that passes.  designs: temperature, design, valid."""
    fresh = staged(novel(designs.where("valid").select("temperature", "design"), known, ["design"]), "fresh")
    bits = F.array_distinct(kmers(F.col("design"), 2))
    spread = reduce(
        DataFrame.unionByName,
        [diversity(fresh.where(F.col("temperature") == k).withColumn("bits", bits), order, n, key="design").withColumn("temperature", F.lit(k)) for k in temperatures],
    )
    sums = designs.groupBy("temperature").agg(F.avg(F.col("valid").cast("double")).alias("validity"), F.count("*").alias("_n"))
    sums = sums.join(fresh.groupBy("temperature").agg(F.count("*").alias("_fresh")), "temperature", "left").join(spread, "temperature")
    per = F.round(F.coalesce("_fresh", F.lit(0)) * 1000 / F.col("_n"), 4)
    row = sums.select("temperature", F.round("validity", 6).alias("validity"), per.alias("novel_per_1k"), F.round("diversity", 6).alias("diversity"))
    row = row.withColumn("pass", (F.col("validity") >= 0.7) & (F.col("novel_per_1k") >= 200) & (F.col("diversity") >= 0.7))
    best = row.where("pass").agg(F.max("temperature").alias("_best"))
    return row.join(F.broadcast(best)).withColumn("operating", F.col("pass") & F.coalesce(F.col("temperature") == F.col("_best"), F.lit(False))).drop("_best")


def opposite_partner(df: DataFrame, key: str, label: str) -> DataFrame:
    """For each row one of the other class: its number modulo that class's size, both in order of key."""
    numbers = ranked(df, [label], [key])
    sizes = df.groupBy(label).agg(F.count("*").alias("_m")).select((1 - F.col(label)).alias(label), "_m")
    asking = numbers.join(F.broadcast(sizes), label).select(F.col(key), (1 - F.col(label)).alias(label), F.pmod(F.col("rank") - 1, F.col("_m")).alias("_at"))
    pool = numbers.select(F.col(key).alias("partner"), label, (F.col("rank") - 1).alias("_at"))
    return asking.join(pool, [label, "_at"]).select(key, "partner")


def derangement(df: DataFrame, key: str, seed, name: str = "other") -> DataFrame:
    """Each id with the next in hash order, the last with the first: no row keeps its own, given two or more."""
    from plumbline.functions.hashing import shuffle_key

    numbers = ranked(df.select(key).withColumn("_h", shuffle_key(seed, F.col(key))), [], ["_h", key])
    n = numbers.agg(F.count("*").alias("_n"))
    following = numbers.select(F.col(key).alias(name), F.col("rank").alias("_next"))
    asking = numbers.join(F.broadcast(n)).select(key, (F.pmod(F.col("rank"), F.col("_n")) + 1).alias("_next"))
    return asking.join(following, "_next").select(key, name)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and those old ones whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered in column k; Spark cuts each task's groups to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= k)


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    name: str = "rank",
    parts: int | None = None,
    sums: Mapping[str, Column] | None = None,
    total: str | None = None,
    least: Mapping[str, Column] | None = None,
) -> DataFrame:
    """df with the row number within keys, without sorting a whole group in one task.

    Rows are range-partitioned and sorted by keys and order, and staged with their place, so that counting and numbering
    see the same partitions.  A row's number is its place in its partition, raised by the rows of the group in the
    partitions before it.  Null keys are one group.  sums: running sums of these numbers up to and with each row.
    total: a column for the number of rows of the group.  least: the smallest of these values up to and with each row.
    """
    sums, least = sums or {}, least or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({**sums, **least}).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    held = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *[F.sum(s).alias(s) for s in sums], *[F.min(s).alias(s) for s in least])
    # a row for each partition that a group reaches into
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.min(s).over(before).alias(f"_{s}_before") for s in least],
        *([F.sum("_n").over(group).alias(total)] if total else []),
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raised = {s: F.sum(s).over(upto) + F.col(f"_{s}_before") for s in sums}
    raised |= {s: F.least(F.min(s).over(upto), F.col(f"_{s}_before")) for s in least}
    numbered = dealt.join(offsets, same).withColumns({name: F.col("_at") + F.col("_shift"), **raised})
    return numbered.drop("_at", "_part", "_p", "_shift", *[f"_k{i}" for i in range(len(keys))], *[f"_{s}_before" for s in (*sums, *least)])


def least_above(df: DataFrame, key: str, group: str, value: str, other: DataFrame, other_key: str, other_group: str, other_value: str) -> DataFrame:
    """key, other_key: the smallest key of the other table's rows of the same group with a larger value; keys without such a
    row are left out.

    Both tables are put in one falling order of values, in which the smallest key so far is carried on, so no pairs are made.
    Rows of equal value come before the other table's, which aren't larger.
    """
    # a match is a struct, so that a match whose key is null is still one
    match = F.struct(F.col(other_key).isNull().alias("none"), F.col(other_key).alias("key"))
    kind = f"struct<none: boolean, key: {other.schema[other_key].dataType.simpleString()}>"
    asking = df.select(F.col(key), F.col(group).alias("_g"), F.col(value).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_has"))
    having = other.select(F.lit(None).cast(df.schema[key].dataType).alias(key), F.col(other_group).alias("_g"), F.col(other_value).alias("_v"), F.lit(1).alias("_side"), match.alias("_has"))
    both = asking.unionByName(having).where("_g is not null and _v is not null")
    met = ranked(both, ["_g"], [F.desc("_v"), F.col("_side"), F.col(key)], "_rank", least={"_best": F.col("_has")}).where("_side = 0 and _best is not null")
    return met.groupBy(key).agg(F.min("_best").alias("_best")).select(key, F.col("_best.key").alias(other_key))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "percentiles") -> DataFrame:
    """keys, and an array of these exact percentiles of each group, interpolated between neighbours; nulls are left out.

    Values are counted first, and ranked by partition, so no task holds all values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = ranked(counts, keys, ["_v"], "_r", sums={"_upto": F.col("_c")})
    all_rows = counts.groupBy(*keys).agg(F.sum("_c").alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    placed = upto.join(all_rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_all"), same)

    def at(share: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(share)
        held = lambda k: F.max(F.when((k >= F.col("_upto") - F.col("_c")) & (k < F.col("_upto")), F.col("_v")))
        low, high, over = held(F.floor(place)), held(F.ceil(place)), F.max(place - F.floor(place))
        between = low * (1 - over) + high * over
        return F.when(low == high, low).otherwise(F.greatest(low, F.least(high, between)))  # equal neighbours aren't rounded

    return placed.groupBy(*keys).agg(F.array(*[at(s) for s in shares]).alias(name))


def systematic(df: DataFrame, order: list[str], n: int, ends: bool = False, name: str = "i") -> DataFrame:
    """n evenly spaced rows in this order: row floor(i * count / n), or with both ends, floor(i * (count - 1) / (n - 1))."""
    numbers = ranked(df, [], order, "_rank")
    count = df.agg(F.count("*").alias("_n"))
    picks = df.sparkSession.range(n).withColumnRenamed("id", name).join(F.broadcast(count))
    step = (F.col("_n") - 1) / (n - 1) if ends else F.col("_n") / n
    at = F.floor(F.col(name) * (F.col("_n") - 1) / (n - 1)) if ends else F.floor(F.col(name) * step)
    return numbers.join(F.broadcast(picks.select(name, (at + 1).alias("_rank"))), "_rank").drop("_rank")


def anonymized(df: DataFrame, column: str, prefix: str, name: str | None = None) -> DataFrame:
    """df with each value's name: its place among the values in use."""
    tokens = ranked(df.select(column).distinct(), [], [column], "_place")
    return df.join(tokens.select(column, F.concat(F.lit(f"{prefix}_"), F.col("_place")).alias(name or prefix)), column)


def sections(df: DataFrame, keys: list[str], order: list[str], header: Column, name: str = "section") -> DataFrame:
    """df with the number of headers up to each row of its group; a group may be dealt to many tasks, whose counts are carried on."""
    return ranked(df, keys, order, "_rank", sums={name: F.coalesce(header, F.lit(False)).cast("long")}).drop("_rank")


def to_common_length(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first rows of each group in this order, as many as the smallest group has; no group is gathered in a row or task."""
    least = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return ranked(df, keys, order, "_rank").join(F.broadcast(least)).where(F.col("_rank") <= F.col("_least")).drop("_rank", "_least")


def best_within_budgets(df: DataFrame, order: Column, reward: str, budgets: list[int], m: int, key: str = "id") -> DataFrame:
    """For each budget, the m best by reward among the first rows in this order."""
    drawn = df.withColumn("_o", order).orderBy("_o", key).limit(max(budgets))
    numbered = drawn.withColumn("_rn", F.row_number().over(Window.orderBy("_o", key)))
    dealt = numbered.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where(F.col("_rn") <= F.col("budget"))
    return top_per_group(dealt, ["budget"], [F.desc(reward), F.col(key)], m).select("budget", key, "k")
