"""Routing between a model and a specialist, placement rules and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.metrics import ratio
from plumbline.operators.relational import ranked


def _right(err: str) -> Column:
    return 1.0 - F.col(err)


def policies(df: DataFrame, keys: list[str], err: str = "err", spec_err: str = "spec_err", conf: str = "conf", route: str = "route") -> DataFrame:
    """Accuracy of each policy: always the model, always the specialist, the model's own choice, the best confidence
    threshold in sample, and an oracle that takes whichever is right."""
    own = F.when(F.col(route) == "SELF", _right(err)).otherwise(_right(spec_err))
    base = df.groupBy(*keys).agg(
        F.avg(_right(err)).alias("always_model"),
        F.avg(_right(spec_err)).alias("always_spec"),
        F.avg(own).alias("own_defer"),
        F.avg(F.greatest(_right(err), _right(spec_err))).alias("oracle"),
    )
    return base.join(threshold_policy(df, keys, err, spec_err, conf).select(*keys, F.col("accuracy").alias("conf_route")), keys)


def threshold_policy(df: DataFrame, keys: list[str], err: str = "err", spec_err: str = "spec_err", conf: str = "conf") -> DataFrame:
    """keys, threshold, accuracy, calls: the model answers at or above the threshold; every distinct confidence is
    tried, and one above all.  Of equals the smallest threshold wins."""
    counts = df.groupBy(*keys, F.col(conf).alias("t")).agg(F.count("*").alias("n"), F.sum(_right(err)).alias("m"), F.sum(_right(spec_err)).alias("s"))
    above = df.select(*keys).distinct().select(*keys, F.lit(1.01).alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
    w = Window.partitionBy(*keys).orderBy("t")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    spec = F.coalesce(F.sum("s").over(below), F.lit(0.0))
    own = F.sum("m").over(whole) - F.coalesce(F.sum("m").over(below), F.lit(0.0))
    tried = counts.unionByName(above).select(*keys, "t", ((spec + own) / F.sum("n").over(whole)).alias("a"), (F.coalesce(F.sum("n").over(below), F.lit(0)) / F.sum("n").over(whole)).alias("c"))
    best = tried.groupBy(*keys).agg(F.max(F.struct(F.round("a", 9).alias("a"), (-F.col("t")).alias("t"), F.col("c").alias("c"))).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.a").alias("accuracy"), F.col("b.c").alias("calls"))


def coverage_routing(df: DataFrame, keys: list[str], order: list[Column], err: str = "err", spec_err: str = "spec_err") -> DataFrame:
    """keys, coverage, routed: the model on the first k in this order and the specialist on the rest, at the best k of
    all from 0 to n; of equals the smallest."""
    cut = ranked(df, keys, order, "k", sums={"gain": _right(err) - _right(spec_err)}).select(*keys, "k", "gain")
    whole = df.groupBy(*keys).agg(F.sum(_right(spec_err)).alias("spec"), F.count("*").alias("n"))
    none = whole.select(*keys, F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("gain"))
    best = cut.unionByName(none).groupBy(*keys).agg(F.max(F.struct(F.round("gain", 6).alias("gain"), (-F.col("k")).alias("k"))).alias("b")).join(whole, keys)
    return best.select(*keys, (-F.col("b.k") / F.col("n")).alias("coverage"), ((F.col("spec") + F.col("b.gain")) / F.col("n")).alias("routed"))


def group_utility(df: DataFrame, keys: list[str], group: str, err: str = "err", spec_err: str = "spec_err", route: str = "route") -> DataFrame:
    """Mean over groups: of the model, of the specialist, of whichever the group's defer rate chooses, of the better one."""
    g = df.groupBy(*keys, group).agg(F.avg(_right(err)).alias("m"), F.avg(_right(spec_err)).alias("s"), F.avg((F.col(route) == "DEFER").cast("double")).alias("d"))
    return g.groupBy(*keys).agg(
        F.avg("m").alias("self"), F.avg("s").alias("tool"), F.avg(F.when(F.col("d") > 0.5, F.col("s")).otherwise(F.col("m"))).alias("routed"), F.avg(F.greatest("m", "s")).alias("oracle")
    )


def reliability_routing(df: DataFrame, keys: list[str], group: str, half: Column, err: str = "err", spec_err: str = "spec_err") -> DataFrame:
    """Groups go to whichever did better: on all rows, and on the other half."""
    halves = df.withColumn("half", half)
    means = halves.groupBy(*keys, group, "half").agg(F.sum(_right(err)).alias("m"), F.sum(_right(spec_err)).alias("s"), F.count("*").alias("n"))
    other = means.select(*keys, group, (1 - F.col("half")).alias("half"), (F.col("m") >= F.col("s")).alias("to_model"))
    swapped = means.join(other, [*keys, group, "half"], "left")
    pick = lambda c: F.when(c, F.col("m")).otherwise(F.col("s"))
    both = means.groupBy(*keys, group).agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    inside = both.groupBy(*keys).agg((F.sum(F.greatest("m", "s")) / F.sum("n")).alias("in_sample"))
    outside = swapped.groupBy(*keys).agg((F.sum(pick(F.coalesce("to_model", F.lit(True)))) / F.sum("n")).alias("two_fold"))
    return inside.join(outside, keys)


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The verdict of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, verdict in reversed(rules):
        out = F.when(condition, verdict).otherwise(out)
    return out


def placement(encoding_gap: Column, expression_gap: Column, wide: float = 0.1) -> Column:
    return first_match(
        [
            ((encoding_gap > wide) & (expression_gap > wide), "specialist"),
            (encoding_gap > wide, "encoder"),
            (expression_gap > wide, "bridge"),
            (expression_gap < -wide, "check labels"),
        ],
        "model",
    )


def within(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.between(low, high), "inside").otherwise("outside")


def covariate_flags(df: DataFrame, keys: list[str], covariate: str, other: str) -> DataFrame:
    """Whether a covariate is at its ceiling in 80 % of rows, and whether it runs along with another."""
    top = F.avg((F.col(covariate) >= 1.0).cast("double"))
    return df.groupBy(*keys).agg((top >= 0.8).alias("ceiling_effect"), (F.abs(F.corr(covariate, other)) > 0.7).alias("collinear"))


def excess_over(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, ratio of the largest to the mean."""
    return df.groupBy(*keys).agg(ratio(F.max(value), F.avg(value)).alias("excess"))
