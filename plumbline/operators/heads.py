"""Cheap learned heads, and the gates and placements built on them.

Logistic heads of all folds, layers, controls and members are fitted in one pass a step (``operators.linear``).  Forests, and
heads of more features than it takes, are independent fits, run from a few driver threads over one frame of vectors.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, ElementwiseProduct, HashingTF, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sequences import kmers
from plumbline.operators.linear import MOST_FEATURES, Arm, fit, scored
from plumbline.operators.metrics import auroc
from plumbline.sources.staging import staged

FITS_AT_ONCE = 4
ROWS_A_TASK = 50_000


def vectors(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    """df with an array as an ML vector; rows without one are left out."""
    return df.where(F.col(column).isNotNull()).withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """df with n / (2 * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = n.join(F.broadcast(n.agg(F.sum("_n").alias("_all")))).select(label, (F.col("_all") / (2 * F.col("_n"))).alias(name))
    return df.join(F.broadcast(sizes), label)


def linear_head(df: DataFrame, c: float = 1.0, label: str = "label") -> PipelineModel:
    """Standardized logistic regression with balanced classes; its penalty is that of inverse strength c.

    Features are scaled but not centred, which the intercept, free of penalty, makes up for: so sparse ones stay sparse.
    """
    data = class_weights(df, label)
    n = data.count()
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True)
    fit = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=1 / (c * max(1, n)), standardization=False, maxIter=100)
    return Pipeline(stages=[scale, fit]).fit(data)


def forest_head(df: DataFrame, trees: int = 30, label: str = "label", seed: int = 0) -> PipelineModel:
    fit = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=8, seed=seed)
    return Pipeline(stages=[fit]).fit(class_weights(df, label))


Head = Callable[[DataFrame], PipelineModel]


def score(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    """df with the probability of class 1."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def few_parts(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, staged and read in as few tasks as they need, one a core at least where it has so many files.

    Fits of many steps send the driver something from every task of every step, so these follow rows, not shuffle partitions.
    """
    rows = staged(df, name)
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)))


def out_of_fold(df: DataFrame, folds: int, head: Head = linear_head, fold: str = "fold", name: str = "prob") -> DataFrame:
    """df with each row's probability under a head that hasn't seen its fold."""
    first = df.select(F.size(vector_to_array("features")).alias("n")).first()
    if head is linear_head and first and first.n <= MOST_FEATURES:
        heads = fit(df, [Arm(F.col(fold) != k, F.col("label")) for k in range(folds)])
        return staged(scored(df, heads).withColumn(name, F.get("probs", F.col(fold))).drop("probs"), "out-of-fold")
    held = few_parts(df, "folds").persist()
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = list(pool.map(lambda k: score(head(held.where(F.col(fold) != k)), held.where(F.col(fold) == k), name), range(folds)))
    done = staged(reduce(DataFrame.unionByName, parts), "out-of-fold")
    held.unpersist()
    return done


def gate(df: DataFrame, folds: int, random_fold: Column, cold_fold: Column, shuffled: str, forest: bool = True) -> DataFrame:
    """One row: AUROC at random, across groups, of a forest across groups, and of shuffled labels; selectivity,
    leakage_drop and the verdict: PASS from 0.65 across groups and 0.10 over shuffled labels.

    The logistic heads of all three arms and all folds are fitted together.
    """
    rows = df.withColumns({"_random": random_fold, "_cold": cold_fold})
    runs = {"random": ("_random", "label"), "cold": ("_cold", "label"), "control": ("_random", shuffled)}
    heads = fit(rows, [Arm(F.col(fold) != k, F.col(label)) for fold, label in runs.values() for k in range(folds)])
    probs = {name: F.get("probs", F.col(fold) + k * folds) for k, (name, (fold, _)) in enumerate(runs.items())}
    held = staged(scored(rows, heads).select("label", shuffled, *[p.alias(name) for name, p in probs.items()]), "gate")
    parts = [auroc(held, [], name, label, name=name) for name, (_, label) in runs.items()]
    if forest:
        parts.append(auroc(out_of_fold(df.drop(shuffled).withColumn("fold", cold_fold), folds, forest_head), [], name="forest_cold"))
    row = reduce(lambda a, b: a.join(b), parts)
    best = F.greatest("cold", "forest_cold") if forest else F.col("cold")
    row = row.withColumns({"selectivity": best - F.col("control"), "leakage_drop": F.col("random") - F.col("cold")})
    return row.withColumn("verdict", F.when((best >= 0.65) & (F.col("selectivity") >= 0.10), "PASS").otherwise("FAIL"))


def _layer_place(layer: str, layers: list[int]) -> Column:
    return F.array_position(F.array(*map(F.lit, layers)), F.col(layer)) - 1


def layer_curve(df: DataFrame, layers: list[int], folds: int, layer: str = "layer", label: str = "label") -> DataFrame:
    """layer, auroc: out of fold, of each layer's vectors, which are equally long; all are fitted together."""
    heads = fit(df, [Arm((F.col(layer) == n) & (F.col("fold") != k), F.col(label)) for n in layers for k in range(folds)])
    prob = F.get("probs", (_layer_place(layer, layers) * folds + F.col("fold")).cast("int"))
    return auroc(scored(df, heads).select(layer, F.col(label).alias("label"), prob.alias("prob")), [layer])


def layer_selectivity(df: DataFrame, layers: list[int], folds: int, shuffled: str) -> DataFrame:
    """layer, auroc, control, selectivity: beside each layer's AUROC, that of the same head on shuffled labels."""
    arms = [Arm((F.col("layer") == n) & (F.col("fold") != k), F.col(label)) for n in layers for k in range(folds) for label in ("label", shuffled)]
    at = 2 * (_layer_place("layer", layers) * folds + F.col("fold"))
    probs = [F.get("probs", (at + k).cast("int")).alias(name) for k, name in enumerate(("prob", "prob_control"))]
    held = staged(scored(df, fit(df, arms)).select("layer", "label", shuffled, *probs), "selectivity")
    both = auroc(held, ["layer"]).join(auroc(held, ["layer"], "prob_control", shuffled, name="control"), "layer")
    return both.withColumn("selectivity", F.col("auroc") - F.col("control"))


def nested_layer(df: DataFrame, layers: list[int], folds: int) -> DataFrame:
    """fold, layer, auroc, band, pooled: the layer that does best out of fold on the other folds, how it does on this one,
    the layers within a standard error of it there, and the AUROC of all folds' predictions together.

    The heads that leave out one fold or two, of all layers, are fitted together: a pair serves both of its folds.
    """
    left_out = [(k,) for k in range(folds)] + [(k, j) for k in range(folds) for j in range(k + 1, folds)]
    heads = fit(df, [Arm((F.col("layer") == n) & ~F.col("fold").isin(*out), F.col("label")) for n in layers for out in left_out])
    base = _layer_place("layer", layers) * len(left_out)
    places = {out: k for k, out in enumerate(left_out)}
    # by the row's fold, then by the other one that is left out
    table = F.array(*[F.array(*[F.lit(places[tuple(sorted({f, k}))]) for k in range(folds)]) for f in range(folds)])
    held = staged(scored(df, heads).select("layer", "label", "fold", F.slice("probs", (base + 1).cast("int"), len(left_out)).alias("probs")), "nested-heads")
    outer = held.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("outer") != F.col("fold"))
    inner = outer.select("outer", "layer", "label", F.get("probs", F.get(F.get(table, F.col("fold")), F.col("outer"))).alias("prob"))
    curves: dict[int, dict[int, float]] = {}
    for row in auroc(inner, ["outer", "layer"]).collect():  # a row for each fold and layer
        curves.setdefault(row["outer"], {})[row["layer"]] = row["auroc"]
    bands, best = [], {}
    for k, curve in sorted(curves.items()):
        best[k] = max(sorted(curve), key=lambda n: curve[n])
        error = statistics.stdev(curve.values()) / math.sqrt(len(curve)) if len(curve) > 1 else 0.0
        bands.append((k, best[k], sorted(n for n in curve if curve[n] >= curve[best[k]] - error)))
    band = df.sparkSession.createDataFrame(bands, "fold int, layer int, band array<int>")
    every = held.join(F.broadcast(band.drop("band")), ["fold", "layer"]).select("fold", "layer", "label", F.get("probs", F.col("fold")).alias("prob"))
    return auroc(every, ["fold", "layer"]).join(F.broadcast(band.drop("layer")), "fold").join(F.broadcast(auroc(every, [], name="pooled")))


def hashed_ngrams(df: DataFrame, tokens: Column, size: int = 1024) -> DataFrame:
    """df with hashed, normalized counts of tokens as features."""
    data = df.withColumn("_t", tokens)
    stages = [HashingTF(inputCol="_t", outputCol="_f", numFeatures=size), Normalizer(inputCol="_f", outputCol="features")]
    return Pipeline(stages=stages).fit(data).transform(data).drop("_t", "_f")


def tf_idf(df: DataFrame, tokens: Column, least: int = 2, most: int = 3000) -> DataFrame:
    """df with term counts times ln((1 + n) / (1 + df)) + 1, normalized; terms of fewer than ``least`` documents are left out."""
    data = df.withColumn("_t", tokens)
    model = CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=most, minDF=least).fit(data)
    counted = model.transform(data)
    seen = IDF(inputCol="_c", outputCol="_v").fit(counted)
    weights = [math.log((1 + seen.numDocs) / (1 + n)) + 1 for n in seen.docFreq]
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_c", outputCol="_v").transform(counted)  # sparse, as counts are
    return Normalizer(inputCol="_v", outputCol="features").transform(weighed).drop("_t", "_c", "_v")


def bag_of_tokens(df: DataFrame, tokens: Column, most: int = 2000) -> DataFrame:
    data = df.withColumn("_t", tokens)
    return CountVectorizer(inputCol="_t", outputCol="features", vocabSize=most, binary=True).fit(data).transform(data).drop("_t")


def cluster_groups(df: DataFrame, seed: int = 0, name: str = "grp") -> DataFrame:
    """df with k-means clusters as groups, k being rows / 150 between 5 and 25."""
    k = max(5, min(25, df.count() // 150))
    return KMeans(k=k, seed=seed, predictionCol=name).fit(df).transform(df)


def principal(df: DataFrame, k: int) -> DataFrame:
    """df with its features scaled and reduced to k components."""
    stages = [StandardScaler(inputCol="features", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_p")]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.drop("features", "_s").withColumnRenamed("_p", "features")


def residualized(df: DataFrame, column: str, on: str, folds: int, fold: str = "fold", name: str = "residual") -> DataFrame:
    """df with a column less its linear prediction from another, fitted on the other folds."""
    sums = df.groupBy(fold).agg(*[F.sum(e).alias(n) for n, e in _moments(column, on).items()])
    other = sums.select(F.col(fold).alias("_f"), *_moments(column, on)).join(df.select(fold).distinct(), F.col("_f") != F.col(fold)).groupBy(fold).agg(*[F.sum(n).alias(n) for n in _moments(column, on)])
    slope = F.try_divide(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y"), F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"))
    fits = other.withColumn("_b", F.coalesce(slope, F.lit(0.0))).select(fold, "_b", ((F.col("_y") - F.col("_b") * F.col("_x")) / F.col("_n")).alias("_a"))
    return df.join(F.broadcast(fits), fold).withColumn(name, F.col(column) - F.col("_a") - F.col("_b") * F.col(on)).drop("_a", "_b")


def _moments(y: str, x: str) -> dict[str, Column]:
    return {"_n": F.lit(1.0), "_x": F.col(x), "_y": F.col(y), "_xx": F.col(x) * F.col(x), "_xy": F.col(x) * F.col(y)}


def transfer(source: DataFrame, target: DataFrame, floor: float = 0.5) -> DataFrame:
    """One row: AUROC of the source's head on the target, of the target's own in fold, the share of it that carries
    over, and its band."""
    both = source.select("label", "features", F.lit(0).alias("_side")).unionByName(target.select("label", "features", F.lit(1).alias("_side")))
    heads = fit(both, [Arm(F.col("_side") == k, F.col("label")) for k in range(2)])
    held = staged(scored(target.select("label", "features"), heads).select("label", "probs"), "transfer")
    across, own = (auroc(held.withColumn("prob", F.get("probs", k)), [], name=name) for k, name in enumerate(("transfer", "in_domain")))
    nt = F.try_divide(F.col("transfer") - floor, F.col("in_domain") - floor)
    row = across.join(own).withColumn("nt", nt)
    return row.withColumn("band", F.when(F.col("nt") >= 0.9, "transfers").when(F.col("nt") >= 0.6, "partly").otherwise("fails"))


def ensemble(train: DataFrame, test: DataFrame, draws: Column, members: int, pessimism: float = 1.0) -> DataFrame:
    """test with the mean of bootstrap heads' probabilities less ``pessimism`` of their deviation; all members are fitted together."""
    heads = fit(train, [Arm(F.get(draws, F.lit(k)) > 0, F.col("label")) for k in range(members)])
    mean = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p) / members
    spread = F.sqrt(F.aggregate(F.transform("probs", lambda p: (p - F.col("_mean")) * (p - F.col("_mean"))), F.lit(0.0), lambda s, p: s + p) / members)
    rows = scored(test, heads).withColumn("_mean", mean)
    return rows.withColumn("score", F.col("_mean") - pessimism * spread).drop("features", "probs", "_mean")


# kind of representation -> frame with id, label, grp and rep, to one with features of the rows that have any
Featurizer = Callable[[DataFrame], DataFrame]
FEATURIZERS: dict[str, Featurizer] = {
    "vector": lambda df: vectors(df.where(F.forall("rep", lambda x: x.isNotNull() & ~F.isnan(x))), "rep"),
    "text": lambda df: hashed_ngrams(df.where(F.trim("rep") != ""), F.split(F.lower("rep"), r"\s+")),
    "sequence": lambda df: hashed_ngrams(df.where(F.length("rep") >= 3), kmers(F.upper("rep"), 3)),
    "number": lambda df: vectors(df.withColumn("rep", F.when(F.col("rep").isNotNull(), F.array("rep"))), "rep"),
}


def featurized(df: DataFrame, kind: str) -> DataFrame:
    """id, label, grp and features, by the featurizer of this kind."""
    return FEATURIZERS[kind](df).select("id", "label", "grp", "features")
