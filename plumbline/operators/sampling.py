"""Samples, splits and bootstrap resampling by portable hash order.

Quotas are ranks within a class, made by range partition, so no class is sorted in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import md5_number, shuffle_key
from plumbline.operators.relational import ranked
from plumbline.sources.staging import staged


def _in_hash_order(df: DataFrame, keys: list[str], seed, key: str) -> DataFrame:
    return ranked(df.withColumn("_h", shuffle_key(seed, F.col(key))), keys, ["_h", key], "_rn").drop("_h")


def balanced(df: DataFrame, n: int, seed, key: str = "id", label: str = "label", even: bool = True) -> DataFrame:
    """At most n // 2 rows of each class, and of both as many as the smaller one allows if ``even``."""
    numbered = _in_hash_order(df, [label], seed, key)
    quota = F.lit(n // 2)
    if even:
        sizes = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
        numbered = numbered.join(F.broadcast(sizes))
        quota = F.least(quota, "_p", "_q")
    return numbered.where(F.col("_rn") <= quota).select(*df.columns)


def capped(df: DataFrame, n: int, seed, key: str = "id") -> DataFrame:
    return df.withColumn("_h", shuffle_key(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def degraded(df: DataFrame, positives: int, seed, key: str = "id", label: str = "label") -> DataFrame:
    """So many positives, and negatives in the proportion they had, rounded to even."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    quota = F.when(F.col(label) == 1, F.lit(float(positives))).otherwise(F.bround(positives * F.col("_q") / F.col("_p"), 0))
    return _in_hash_order(df, [label], seed, key).join(F.broadcast(sizes)).where(F.col("_rn") <= quota).select(*df.columns)


def stratified_folds(df: DataFrame, k: int, seed, key: str = "id", label: str = "label") -> DataFrame:
    """df with fold: rows of each class dealt in hash order."""
    numbered = _in_hash_order(df, [label], seed, key)
    return numbered.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")


def group_folds(df: DataFrame, k: int, seed, group: str = "grp") -> DataFrame:
    """df with fold by the group's hash, so a group is never split."""
    return df.withColumn("fold", F.pmod(md5_number(seed, F.col(group)), F.lit(k)).cast("int"))


def group_holdout(df: DataFrame, share: float, seed, group: str = "grp") -> DataFrame:
    """df with test: whole groups in hash order, as long as they start below the share of rows."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", shuffle_key(seed, F.col(group)))
    upto = ranked(sizes, [], ["_h", group], "_rank", sums={"_upto": F.col("_n")})
    cut = upto.join(F.broadcast(df.agg(F.count("*").alias("_all")))).select(group, (F.col("_upto") - F.col("_n") < share * F.col("_all")).alias("test"))
    return df.join(cut, group)


GROUPS_ON_DRIVER = 1_000_000


def group_sums(df: DataFrame, group: str, *sums: Column) -> dict[str, tuple]:
    """The sums of each group, on the driver, for rules that place one group after the other.

    More than GROUPS_ON_DRIVER groups are refused; ``group_folds`` places any number of them.
    """
    found = df.groupBy(group).agg(*sums).limit(GROUPS_ON_DRIVER + 1).collect()
    if len(found) > GROUPS_ON_DRIVER:
        raise ValueError(f"more than {GROUPS_ON_DRIVER} groups to place one by one; use group_folds")
    return {row[0]: tuple(row)[1:] for row in found}


def lightest_first(groups: list[tuple[str, tuple[int, ...]]], loads: list[tuple[int, ...]], by: tuple[int, ...]) -> dict[str, int]:
    """A block for each group, in this order: the one with the least of the loads ``by``, then of lowest number.

    A group's weights are added to its block's loads.
    """
    waiting = [(*(load[w] for w in by), block) for block, load in enumerate(loads)]
    heapq.heapify(waiting)
    out = {}
    for name, weights in groups:
        block = out[name] = waiting[0][-1]
        loads[block] = tuple(map(sum, zip(loads[block], weights, strict=True)))
        heapq.heapreplace(waiting, (*(loads[block][w] for w in by), block))
    return out


def heaviest(groups: dict[str, tuple[int, ...]]) -> list[tuple[str, tuple[int, ...]]]:
    """Groups by falling weights, then by name."""
    return sorted(groups.items(), key=lambda x: (*(-w for w in x[1]), x[0]))


def greedy_folds(sizes: dict[str, int], k: int) -> dict[str, int]:
    """A fold for each group: the largest first, each to the lightest fold."""
    return lightest_first(heaviest({g: (n,) for g, n in sizes.items()}), [(0,)] * k, (0,))


def two_pass_partition(groups: dict[str, tuple[int, int]], k: int) -> dict[str, int]:
    """Groups (positives, rows): those with positives balance positives and then rows; the others fill up rows."""
    loads = [(0, 0)] * k
    scarce, plain = ({g: w for g, w in groups.items() if bool(w[0]) == has} for has in (True, False))
    return lightest_first(heaviest(scarce), loads, (0, 1)) | lightest_first(heaviest(plain), loads, (1,))


def shuffled_labels(df: DataFrame, seed, key: str = "id", label: str = "label", name: str = "shuffled") -> DataFrame:
    """df with a permutation of its labels: the label of the row of equal rank in another hash order."""
    numbers = ranked(df, [], [key], "_rank")
    others = _in_hash_order(df.select(key, label), [], seed, key).select(F.col("_rn").alias("_rank"), F.col(label).alias(name))
    return numbers.join(others, "_rank").drop("_rank")


def reserved_examples(df: DataFrame, k: int, seed, key: str = "id", label: str = "label") -> DataFrame:
    """df with example: k // 2 rows of each class set apart before any query is drawn."""
    return _in_hash_order(df, [label], seed, key).withColumn("example", F.col("_rn") <= k // 2).drop("_rn")


# ---- bootstrap --------------------------------------------------------------------------------------------------


DRAWS_A_TASK = 1_000_000


def _drawn(units: DataFrame, keys: list[str], unit: str, reps: int, seed) -> tuple[DataFrame, DataFrame, bool]:
    """keys, unit, _rank: the units, numbered within their group; keys, rep, _rank, m: how often each number is drawn; and
    whether these are too many for one task.

    Tasks are as many as the draws need at DRAWS_A_TASK each, both where draws are made and where they are counted.
    """
    numbers = staged(ranked(units, keys, [unit], "_rank", total="_n"), "units")
    needed = -(-numbers.count() * reps // DRAWS_A_TASK)
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), needed)
    # every unit makes one draw in each replicate
    making = numbers.select(*keys, "_n", (F.col("_rank") - 1).alias("_i")).repartition(tasks, *keys, "_i")
    drawn = making.select(*keys, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    at = F.pmod(md5_number(seed, F.col("rep"), F.col("_i")), F.col("_n")) + 1
    counts = drawn.select(*keys, "rep", at.alias("_rank")).repartition(tasks, *keys, "_rank").groupBy(*keys, "rep", "_rank").agg(F.count("*").alias("m"))
    return numbers.drop("_n"), counts, needed > 1


def multiplicities(units: DataFrame, keys: list[str], unit: str, reps: int, seed) -> DataFrame:
    """keys, rep, unit, m: how often each unit is drawn in each replicate of its group, with replacement."""
    numbers, counts, _ = _drawn(units, keys, unit, reps, seed)
    return counts.join(numbers, [*keys, "_rank"]).select(*keys, "rep", unit, "m")


def interval(values: DataFrame, keys: list[str], column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """keys, lo, hi: percentile interval over replicates, those without a value left out."""
    p = F.percentile(column, F.array(F.lit(low), F.lit(high)))
    return values.groupBy(*keys).agg(p.alias("_p")).select(*keys, F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi"))


Metric = Callable[[DataFrame, list[str], Column], DataFrame]  # (rows, keys, weight of a row) -> keys and value


def bootstrap(df: DataFrame, keys: list[str], reps: int, seed, metric: Metric, unit: str = "id") -> DataFrame:
    """keys, rep and what ``metric`` gives of each replicate.  ``unit`` is what is drawn: a row's id, or its group."""
    numbers, counts, many = _drawn(df.select(*keys, unit).distinct(), keys, unit, reps, seed)
    placed = df.join(numbers, [*keys, unit])
    # the size of files says little of that of counts: many are never broadcast, but stay in the tasks that made them
    rows = counts.join(placed.hint("merge") if many else placed, [*keys, "_rank"]).drop("_rank")
    return metric(rows, [*keys, "rep"], F.col("m"))


def bootstrap_auroc(df: DataFrame, keys: list[str], reps: int, seed, score: str = "prob", label: str = "label", unit: str = "id") -> DataFrame:
    """keys, rep, auroc: of each replicate."""
    from plumbline.operators.metrics import auroc

    return bootstrap(df, keys, reps, seed, lambda rows, by, w: auroc(rows, by, score, label, weight=w), unit)


def pass_rate_difference(a: DataFrame, b: DataFrame, reps: int, seed, group: str, ok: Column) -> DataFrame:
    """rep, diff: pass rate of a minus that of b, groups of each drawn on their own."""

    def arm(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("k"))
        drawn = multiplicities(sums.select(group), [], group, reps, f"{seed}{name}")
        return drawn.join(sums, group).groupBy("rep").agg((F.sum(F.col("m") * F.col("k")) / F.sum(F.col("m") * F.col("n"))).alias(name))

    return arm(a, "a").join(arm(b, "b"), "rep").select("rep", (F.col("a") - F.col("b")).alias("diff"))


# ---- bootstrap without a row for each draw ----------------------------------------------------------------------

SCORES_A_BLOCK = 4096


def draws_before(bounds: np.ndarray, n: int, reps: int, seed: tuple[int, ...]) -> np.ndarray:
    """For each place in ``bounds`` (rising, 0 to n) and each replicate, how many of n draws from n units are of units before it.

    The draws are split down a tree over the units: those of an interval fall into its first half binomially.  An interval's
    split depends on the seed and its ends alone, so any task that asks about a place is told the same, and the counts of
    all units are multinomial together.  Only intervals with a place inside are split.
    """
    out = np.zeros((len(bounds), reps), np.int64)
    out[bounds >= n] = n
    stack = [(0, n, np.full(reps, n), np.zeros(reps, np.int64))]
    while stack:
        low, high, count, before = stack.pop()
        first, last = np.searchsorted(bounds, [low, high])
        first += int(np.searchsorted(bounds[first:last], low, "right"))  # places at its start are known
        if first == last:
            continue
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(count, (middle - low) / (high - low))
        here = np.searchsorted(bounds, [middle, middle + 1])
        out[here[0] : here[1]] = before + left
        stack += [(low, middle, left, before), (middle, high, count - left, before + left)]
    return out


def split_bootstrap_auroc(df: DataFrame, keys: list[str], reps: int, seed: int, score: str = "prob", label: str = "label") -> DataFrame:
    """keys, rep, auroc: of each replicate, rows being drawn one by one with replacement.

    Rows of equal score and label are exchangeable, so only counts by distinct score are ranked; blocks of them draw how
    often each is in all replicates, and give a row for each replicate.  No exchange has more rows than ``df``, or than
    blocks times replicates.  A group with one class has null.
    """
    from plumbline.operators.metrics import by_score, ratio

    counts = by_score(df, keys, score, label)
    upto = ranked(counts, keys, ["s"], "_rank", sums={"_upto": F.col("n")})
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    same = [upto[k].eqNullSafe(sizes[k]) for k in keys]
    rows = upto.join(sizes, reduce(lambda a, b: a & b, same, F.lit(True))) if keys else upto.join(F.broadcast(sizes))
    key = F.xxhash64(F.lit(seed), *[upto[k] for k in keys])
    rows = rows.select(*[upto[k].alias(k) for k in keys], key.alias("_key"), F.expr(f"(_rank - 1) div {SCORES_A_BLOCK}").alias("_block"), (F.col("_upto") - F.col("n")).alias("_at"), "pos", "n", "_all")

    def drawn(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_at")
        at, pos, n = (block[c].to_numpy(np.int64) for c in ("_at", "pos", "n"))
        bounds = np.concatenate((np.column_stack((at, at + pos)).ravel(), [at[-1] + n[-1]]))
        places, back = np.unique(bounds, return_inverse=True)
        before = draws_before(places, int(block["_all"].iloc[0]), reps, (int(block["_key"].iloc[0]) & 0xFFFFFFFFFFFFFFFF,))[back]
        p, q = np.diff(before, axis=0)[::2], np.diff(before, axis=0)[1::2]
        lower = np.cumsum(q, axis=0) - q
        found = {k: block[k].iloc[0] for k in [*keys, "_block"]}
        return pd.DataFrame(found | {"rep": np.arange(reps), "_p": p.sum(0), "_q": q.sum(0), "_won": (p * (lower + q / 2)).sum(0)})

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    blocks = rows.groupBy(*keys, "_block").applyInPandas(drawn, f"{kinds + ', ' if kinds else ''}_block bigint, rep int, _p bigint, _q bigint, _won double")
    below = F.sum("_q").over(Window.partitionBy(*keys, "rep").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sums = blocks.withColumn("_won", F.col("_won") + F.col("_p") * F.coalesce(below, F.lit(0))).groupBy(*keys, "rep").agg(*[F.sum(c).cast("double").alias(c) for c in ("_won", "_p", "_q")])
    return sums.select(*keys, "rep", ratio(F.col("_won"), F.col("_p") * F.col("_q")).alias("auroc"))
