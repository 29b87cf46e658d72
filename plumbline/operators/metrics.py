"""Discrimination, calibration and selective-prediction metrics as grouped plans.

Scores are first summed by value within a group, with partial aggregation, so windows run over distinct scores.
Undefined metrics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.relational import ranked

BINS = 10


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _up(keys: list[str], order: Column) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def by_score(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """keys, s, n, pos: rows and positives of each distinct score, weighted."""
    w = F.lit(1) if weight is None else weight
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos"))


def auroc(df: DataFrame, keys: list[str], score: str = "prob", label: str = "label", weight: Column | None = None, name: str = "auroc") -> DataFrame:
    """The chance that a positive outranks a negative, ties counting half."""
    counts = by_score(df, keys, score, label, weight)
    rank = F.sum("n").over(_up(keys, F.col("s"))) - (F.col("n") - 1) / 2
    sums = counts.withColumn("r", rank).groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("pos") * F.col("r")).alias("rs"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return sums.select(*keys, ratio(F.col("rs") - p * (p + 1) / 2, p * q).alias(name))


def average_precision(df: DataFrame, keys: list[str], score: str = "prob", label: str = "label", name: str = "ap") -> DataFrame:
    """Sum of precision times gain in recall over thresholds, tied scores together."""
    counts = by_score(df, keys, score, label)
    down = _up(keys, F.col("s").desc())
    precision = F.sum("pos").over(down) / F.sum("n").over(down)
    return counts.withColumn("x", F.col("pos") * precision).groupBy(*keys).agg(ratio(F.sum("x"), F.sum("pos")).alias(name))


def upper_bin(x: Column) -> Column:
    """The bin (lo, hi] of x among BINS on [0, 1], by comparison with i / 10 as a float; 0 is in none."""
    return F.when(x > 0, sum(((x > float(i * 0.1)).cast("int") for i in range(1, BINS)), F.lit(0)))


def lower_bin(x: Column, bins: int = BINS) -> Column:
    """The bin [lo, hi) of x, the last one closed."""
    return sum(((x >= float(i / bins)).cast("int") for i in range(1, bins)), F.lit(0))


def accuracy(df: DataFrame, keys: list[str], pred: str = "pred", label: str = "label", weight: Column | None = None, name: str = "accuracy") -> DataFrame:
    """The weighted share of rows whose prediction is the label."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys).agg(ratio(F.sum(w * (F.col(pred) == F.col(label)).cast("int")), F.sum(w)).alias(name))


def _ece(df: DataFrame, keys: list[str], b: Column, said: Column, true: Column, name: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    bins = df.withColumn("b", b).groupBy(*keys, "b").agg(F.sum(w).alias("n"), F.sum(w * said).alias("said"), F.sum(w * true).alias("true"))
    gap = F.when(F.col("b").isNotNull(), F.abs(F.col("said") - F.col("true"))).otherwise(0.0)
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias(name))


def ece_confidence(df: DataFrame, keys: list[str], prob: str = "prob", label: str = "label", name: str = "ece_conf") -> DataFrame:
    """Expected gap between max(p, 1 - p) and accuracy, over bins open below."""
    conf = F.greatest(F.col(prob), 1 - F.col(prob))
    right = ((F.col(prob) > 0.5).cast("int") == F.col(label)).cast("double")
    return _ece(df, keys, upper_bin(conf), conf, right, name)


def ece_probability(df: DataFrame, keys: list[str], prob: str = "prob", label: str = "label", bins: int = BINS, name: str = "ece_prob", weight: Column | None = None) -> DataFrame:
    """Expected gap between p and the rate of positives, over bins open above."""
    return _ece(df, keys, lower_bin(F.col(prob), bins), F.col(prob), F.col(label).cast("double"), name, weight)


def risk_curve(df: DataFrame, keys: list[str], order: list[Column], err: Column) -> DataFrame:
    """df with k, its rank in this order, and risk, the error rate of the first k."""
    return ranked(df, keys, order, "k", sums={"_errors": err.cast("double")}, total="n").withColumn("risk", F.col("_errors") / F.col("k")).drop("_errors")


def aurc(df: DataFrame, keys: list[str], conf: Column, err: Column, tie: str = "id", name: str = "aurc") -> DataFrame:
    """Mean over k of the error rate of the k most confident."""
    return risk_curve(df, keys, [conf.desc(), F.col(tie)], err).groupBy(*keys).agg(F.avg("risk").alias(name))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, by its series beyond 30; 0 of 0."""
    few = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(30)).cast("int")), F.lit(0.0), lambda t, k: t + F.when(k > 0, 1.0 / k).otherwise(0.0))
    x = n.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)
    return F.when(n <= 30, few).otherwise(series)


def aurc_expected(df: DataFrame, keys: list[str], conf: Column, err: Column, name: str = "aurc") -> DataFrame:
    """aurc in expectation over random orders of ties: within a block of ties errors come at the block's rate.

    The error rate at rank n0 + j is (e0 + r * j) / (n0 + j), that is r + (e0 - r * n0) / (n0 + j), so a block's sum needs
    a difference of harmonic numbers and no row for each rank.
    """
    blocks = df.groupBy(*keys, conf.alias("c")).agg(F.count("*").alias("n"), F.sum(err.cast("double")).alias("e"))
    down = _up(keys, F.col("c").desc())
    blocks = blocks.withColumns({"n0": F.sum("n").over(down) - F.col("n"), "e0": F.sum("e").over(down) - F.col("e")})
    r = F.col("e") / F.col("n")
    block = r * F.col("n") + (F.col("e0") - r * F.col("n0")) * (harmonic(F.col("n0") + F.col("n")) - harmonic(F.col("n0")))
    return blocks.withColumn("sum", block).groupBy(*keys).agg((F.sum("sum") / F.sum("n")).alias(name))


def selective_accuracy(df: DataFrame, keys: list[str], conf: Column, right: Column, coverage: float = 0.5, half_even: bool = False, tie: str = "id", name: str = "sel_acc") -> DataFrame:
    """Accuracy of the most confident share; its size is rounded down, or to the nearest with ties to even."""
    curve = risk_curve(df, keys, [conf.desc(), F.col(tie)], 1 - right)
    size = F.bround(F.col("n") * coverage, 0) if half_even else F.floor(F.col("n") * coverage)
    return curve.where(F.col("k") <= F.greatest(F.lit(1), size)).groupBy(*keys).agg(F.avg(right.cast("double")).alias(name))


def error_rates(df: DataFrame, keys: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """accuracy, false-positive and false-negative rates, and their difference."""
    p, y = F.col(pred), F.col(label)
    sums = df.groupBy(*keys).agg(
        F.avg((p == y).cast("double")).alias("accuracy"),
        ratio(F.count_if((p == 1) & (y == 0)), F.greatest(F.count_if(y == 0), F.lit(1))).alias("fp_rate"),
        ratio(F.count_if((p == 0) & (y == 1)), F.greatest(F.count_if(y == 1), F.lit(1))).alias("fn_rate"),
    )
    return sums.withColumn("asymmetry", F.col("fp_rate") - F.col("fn_rate"))


def midrank(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """df with the tie-averaged rank of a column: values are counted, and the counts ranked."""
    counts = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    upto = ranked(counts, keys, ["_v"], "_r", sums={"_upto": F.col("_c")})
    places = upto.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    same = F.col(column).eqNullSafe(F.col("_v"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(places, same).drop("_v", *[f"_k{i}" for i in range(len(keys))])


def spearman(df: DataFrame, keys: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    return midrank(midrank(df, keys, a, "_ra"), keys, b, "_rb").groupBy(*keys).agg(F.corr("_ra", "_rb").alias(name))


def spearman_ordinal(df: DataFrame, keys: list[str], a: str, b: str, tie: str = "id", name: str = "rho_ordinal") -> DataFrame:
    """Ranks without tie averaging; ties go by id."""
    rows = df.select(*keys, a, b, tie)
    return ranked(ranked(rows, keys, [a, tie], "_ra"), keys, [b, tie], "_rb").groupBy(*keys).agg(F.corr("_ra", "_rb").alias(name))


def temperature(df: DataFrame, keys: list[str], prob: str = "prob", label: str = "label", low: float = 0.2, high: float = 5.0, steps: int = 60) -> DataFrame:
    """The temperature of least negative log-likelihood on a grid; the first of equals."""
    counts = by_score(df, keys, prob, label)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(low) + i * ((high - low) / (steps - 1))))
    scaled = counts.withColumn("t", grid).withColumn("q", scale(F.col("s"), F.col("t")))
    loss = -(F.col("pos") * F.log("q") + (F.col("n") - F.col("pos")) * F.log(1 - F.col("q")))
    fits = scaled.groupBy(*keys, "t").agg((F.sum(loss) / F.sum("n")).alias("nll"))
    return fits.groupBy(*keys).agg(F.min(F.struct(F.round("nll", 9), "t")).alias("best")).select(*keys, F.col("best.t").alias("temperature"))


def clip(p: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def logit(p: Column) -> Column:
    return F.log(clip(p) / (1 - clip(p)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def scale(p: Column, t: Column) -> Column:
    """p at temperature t."""
    return clip(sigmoid(logit(p) / t))
