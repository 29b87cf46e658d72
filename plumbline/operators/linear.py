"""Many logistic heads at once: all folds, layers and control labels in one pass over the rows a step.

A head is an arm: which rows it learns from, and by which label.  Each step reads the rows once; every task sums, for each
arm that isn't done, the loss, its gradient and the weighted normal equations; Spark adds these up by arm and place, and
the driver, which holds only arms by features, takes a Newton step for each.  Features are standardized by the mean and
deviation of an arm's own rows, classes weighed evenly, the penalty is that of inverse strength c, the intercept has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.staging import staged

MOST_FEATURES = 256  # the equations of an arm have the square of it
MOST_STEPS = 60
CLOSE = 1e-10
SURE = 30.0  # log odds of a head that has seen one class only


@dataclass(frozen=True)
class Arm:
    train: Column  # whether a row is learned from
    label: Column


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray  # of standardized features
    intercept: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.coef + self.intercept


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and for each arm whether a row is its and the row's label."""
    n = batch.num_rows
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return flat("x"), flat("train") > 0, flat("label").astype(float)


def _summed(rows: DataFrame, per_arm: Callable[[int, np.ndarray, np.ndarray], np.ndarray], arms: list[int]) -> dict[int, np.ndarray]:
    """For each arm the sum over its rows of what ``per_arm`` (arm, features, labels) gives.

    Tasks send their sums as (arm, place, value); they are added up by Spark, and arms by places reach the driver.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, train, label = _rows(batch)
            for a in arms:
                own = train[:, a]
                if own.any():
                    found = per_arm(a, x[own], label[own, a])
                    sums[a] = sums[a] + found if a in sums else found
        for a, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), a, np.int32)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["arm", "at", "value"])

    found = rows.mapInArrow(local, "arm int, at int, value double").groupBy("arm", "at").agg(F.sum("value").alias("value")).toArrow()
    arm, at, value = (found.column(c).to_numpy() for c in ("arm", "at", "value"))
    out = {}
    for a in np.unique(arm):
        own = arm == a
        out[int(a)] = value[own][np.argsort(at[own])]
    return out


def fit(df: DataFrame, arms: list[Arm], features: str = "features", c: float = 1.0) -> list[Linear]:
    """A head for each arm.  An arm with rows of one class is sure of it, one without rows undecided.

    ``df`` is staged once, with its features as arrays, all as long; at most MOST_FEATURES.
    """
    x = F.col(features)
    x = x if df.schema[features].dataType.typeName() == "array" else vector_to_array(x)
    kept = df.select(x.alias("x"), F.array(*[F.coalesce(a.train, F.lit(False)).cast("byte") for a in arms]).alias("train"), F.array(*[a.label.cast("byte") for a in arms]).alias("label"))
    rows = staged(kept, "heads")
    first = rows.select(F.size("x").alias("n")).first()
    d = first.n if first else 0
    if d > MOST_FEATURES:
        raise ValueError(f"{d} features; heads of more than {MOST_FEATURES} are fitted one by one")
    rows = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    moments = _summed(rows, lambda a, x, y: np.concatenate(([len(y), y.sum()], x.sum(0), (x * x).sum(0))), list(range(len(arms))))
    heads, weights = [], []
    for a in range(len(arms)):
        n, positive, *rest = moments.get(a, np.zeros(2 + 2 * d))
        sums = np.array(rest).reshape(2, d)
        mean = sums[0] / max(n, 1)
        deviation = np.sqrt(np.maximum(sums[1] / max(n, 1) - mean**2, 0))
        small = deviation <= 1e-12 * np.maximum(1, np.abs(mean))  # constant but for rounding
        one_class = positive in (0, n)
        heads.append(Linear(mean, np.where(small, 1.0, deviation), np.zeros(d), 0.0 if not n or not one_class else SURE if positive else -SURE))
        weights.append(None if one_class else (n / (2 * (n - positive)), n / (2 * positive)))
    _newton(rows, heads, weights, c)
    return heads


def _newton(rows: DataFrame, heads: list[Linear], weights: list[tuple[float, float] | None], c: float) -> None:
    d = len(heads[0].coef)
    upper = np.triu_indices(d + 1)
    waiting = [a for a, w in enumerate(weights) if w]
    before: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(MOST_STEPS):
        if not waiting:
            return

        def equations(a: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            head = heads[a]
            z = np.column_stack(((x - head.mean) / head.scale, np.ones(len(y))))
            odds = z @ np.append(head.coef, head.intercept)
            s = np.where(y > 0, weights[a][1], weights[a][0])
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            loss = (s * (np.logaddexp(0, odds) - y * odds)).sum()
            curve = (z * (s * p * (1 - p))[:, None]).T @ z
            return np.concatenate(([loss], z.T @ (s * (p - y)), curve[upper]))

        sums = _summed(rows, equations, waiting)
        left = []
        for a in waiting:
            head, found = heads[a], sums[a]
            at = np.append(head.coef, head.intercept)
            held = np.append(head.coef, 0.0)
            loss = c * found[0] + held @ held / 2
            if a in before and loss > before[a][0] + 1e-9 * abs(before[a][0]):
                at = (at + before[a][1]) / 2  # too far: half the way back
                head.coef, head.intercept = at[:-1], float(at[-1])
                left.append(a)
                continue
            curve = np.zeros((d + 1, d + 1))
            curve[upper] = c * found[d + 2 :]
            curve = curve + np.triu(curve, 1).T + np.diag(np.append(np.ones(d), 1e-12))
            step = np.linalg.solve(curve, c * found[1 : d + 2] + held)
            before[a] = loss, at
            head.coef, head.intercept = (at - step)[:-1], float((at - step)[-1])
            if np.abs(step).max() > CLOSE:
                left.append(a)
        waiting = left
    raise ValueError(f"no fit within {MOST_STEPS} steps")


def scored(df: DataFrame, heads: list[Linear], features: str = "features", name: str = "probs") -> DataFrame:
    """df with the probability of class 1 under each head."""

    @F.pandas_udf("array<double>")
    def probabilities(xs: pd.Series) -> pd.Series:
        if xs.empty:
            return pd.Series([], dtype=object)
        x = np.stack(xs.to_list())
        odds = np.column_stack([h.log_odds(x) for h in heads])
        return pd.Series(list(1 / (1 + np.exp(-np.clip(odds, -700, 700)))))

    x = F.col(features)
    return df.withColumn(name, probabilities(x if df.schema[features].dataType.typeName() == "array" else vector_to_array(x)))
