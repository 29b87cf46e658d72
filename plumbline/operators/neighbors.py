"""Exact nearest neighbours of feature sets by Tanimoto similarity: a top-k similarity join.

Rows of equal features are one class, searched once.  Features are joined from the rarest on, in rounds.  After a round, a
row that no joined feature led to can share only the features not yet joined, which bounds its similarity; queries whose
k-th best is above that are done.  Features that more than ``most`` classes have are never joined.  What they may still
bring to a query is found among the distinct combinations of them, blocks of queries against slices of combinations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import top_per_group
from plumbline.sources.staging import staged

MOST = 1000  # classes that a joined feature may have
RARE = 30  # and in the first round
BLOCK, SLICE, STRIP = 1024, 20_000, 256


def named(df: DataFrame, bits: str, apart: str | None, key: str) -> DataFrame:
    """id, b, a, c of the rows with features: c names the class of their features and the value that must differ."""
    b = F.sort_array(F.array_distinct(F.filter(bits, lambda x: x.isNotNull())))
    a = F.col(apart) if apart else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("id"), b.alias("b"), a.alias("a")).where(F.size("b") > 0)
    return rows.withColumn("c", F.sha2(F.to_json(F.struct("b", "a")), 256))


def classes(df: DataFrame, bits: str, apart: str | None, key: str, held: int | None) -> DataFrame:
    """c, b, a, n: the distinct feature sets, with the value that must differ; ids: the first ``held`` of each, if given."""
    rows = named(df, bits, apart, key)
    ids = []
    if held:
        rows = top_per_group(rows, ["c"], [F.col("id")], held)
        ids = [F.sort_array(F.collect_list("id")).alias("ids")]
    return rows.groupBy("c").agg(F.any_value("b").alias("b"), F.any_value("a").alias("a"), *ids).withColumn("n", F.size("b"))


def _differ(apart: str | None, left: str, right: str) -> Column:
    return F.col(left) != F.col(right) if apart else F.lit(True)


def _best(rows: DataFrame, held: int) -> DataFrame:
    """q, neighbor, sim: the best rows of each query class."""
    once = rows.groupBy("q", "neighbor").agg(F.max("sim").alias("sim"))
    return top_per_group(once, ["q"], [F.desc("sim"), F.col("neighbor")], held).drop("k")


def _met(features: DataFrame, queries: DataFrame, pool: DataFrame, bounds: DataFrame | None, apart: str | None, held: int) -> DataFrame:
    """q, neighbor, sim of the classes that share one of these features of a query, with their first ids."""
    has = pool.select(F.col("c").alias("p"), F.col("a").alias("a_p"), F.explode("b").alias("f"))
    pairs = features.join(has, "f").where(_differ(apart, "a", "a_p")).select("q", "p").distinct()
    pairs = pairs.join(queries.select(F.col("c").alias("q"), F.col("b").alias("b_q"), F.col("n").alias("n_q")), "q")
    pairs = pairs.join(pool.select(F.col("c").alias("p"), "b", "n", "ids"), "p")
    if bounds is not None:
        ratio = F.least("n", "n_q") / F.greatest("n", "n_q")
        pairs = pairs.join(bounds.select("q", "bound"), "q").where(ratio >= F.col("bound"))
    both = F.size(F.array_intersect("b", "b_q"))
    found = pairs.withColumn("both", both).select("q", "ids", (F.col("both") / (F.col("n") + F.col("n_q") - F.col("both"))).alias("sim"))
    found = top_per_group(found, ["q"], [F.desc("sim"), F.col("ids")[0]], held)
    return found.select("q", F.explode("ids").alias("neighbor"), "sim")


def _open(features: DataFrame, queries: DataFrame, best: DataFrame, upto: int, held: int) -> DataFrame:
    """q, bound: queries that features of more than ``upto`` classes may still bring a better neighbour, and their last
    best similarity (0 if they have too few)."""
    rest = features.where(F.col("df") > upto).groupBy("q").agg(F.count("*").alias("rest"))
    last = best.groupBy("q").agg(F.when(F.count("*") >= held, F.min("sim")).otherwise(0.0).alias("bound"))
    sizes = queries.select(F.col("c").alias("q"), "n")
    state = rest.join(sizes, "q").join(last, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    return state.where(F.col("bound") <= F.col("rest") / F.col("n")).select("q", "bound")


def _common(features: DataFrame, queries: DataFrame, pool: DataFrame, waiting: DataFrame, apart: str | None, held: int, most: int) -> DataFrame:
    """q, neighbor, sim by common features alone, for the queries still open.

    A combination of common features and a size is compared once, whatever rows have it; its first ids stand for it.
    Rows that share other features too were met before, at a higher similarity.
    """
    common = pool.select(F.explode("b").alias("f")).groupBy("f").agg(F.count("*").alias("df")).where(F.col("df") > most).select("f")
    shared = pool.select("c", F.explode("b").alias("f")).join(common, "f").groupBy("c").agg(F.sort_array(F.collect_list("f")).alias("h"))
    ids = pool.join(shared, "c").select("h", "n", "a", F.explode("ids").alias("id"))
    combined = top_per_group(ids, ["h", "n", "a"], [F.col("id")], held).groupBy("h", "n", "a").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    combined = staged(combined, "combinations")
    asked = features.where(F.col("df") > most).groupBy("q", "a").agg(F.sort_array(F.collect_list("f")).alias("h"))
    asked = staged(asked.join(waiting, "q").join(queries.select(F.col("c").alias("q"), F.col("n").alias("n_q")), "q"), "open-queries")
    blocks, slices = -(-asked.count() // BLOCK) or 1, -(-combined.count() // SLICE) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    right = combined.withColumn("slice", F.pmod(F.xxhash64("h", "n", "a"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    kind = pool.schema["ids"].dataType.simpleString()

    def compare(asking: pd.DataFrame, having: pd.DataFrame) -> pd.DataFrame:
        rows = list(_compared(asking, having, held, bool(apart)))
        return pd.DataFrame(rows, columns=["q", "ids", "sim"])

    met = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(compare, f"q string, ids {kind}, sim double")
    return met.select("q", F.explode("ids").alias("neighbor"), "sim")


def _compared(asking: pd.DataFrame, having: pd.DataFrame, held: int, apart: bool) -> Iterator[tuple]:
    """The best ``held`` combinations for each query of a block, by similarity, then by first id."""
    if asking.empty or having.empty:
        return
    asking = asking.reset_index(drop=True)
    having = having.assign(first=[ids[0] for ids in having["ids"]]).sort_values("first", kind="stable").reset_index(drop=True)
    place: dict = {}
    for h in asking["h"]:
        for f in h:
            place.setdefault(f, len(place))
    member = np.zeros((len(place) + 1, len(asking)), np.int16)  # the last row is of features that no query has
    for q, h in enumerate(asking["h"]):
        member[[place[f] for f in h], q] = 1
    sizes, bound = asking["n_q"].to_numpy(), asking["bound"].to_numpy()
    best, of = np.zeros((0, len(asking))), np.zeros((0, len(asking)), np.int64)
    for at in range(0, len(having), STRIP):
        strip = having.iloc[at : at + STRIP]
        both = np.stack([member[[place.get(f, len(place)) for f in h]].sum(axis=0) for h in strip["h"]])
        sim = both / (strip["n"].to_numpy()[:, None] + sizes[None, :] - both)
        if apart:
            same = strip["a"].to_numpy()[:, None] == asking["a"].to_numpy()[None, :]
            sim[same | strip["a"].isna().to_numpy()[:, None] | asking["a"].isna().to_numpy()[None, :]] = 0
        sim[sim < bound[None, :]] = 0
        sim = np.concatenate((best, sim))
        rows = np.concatenate((of, np.broadcast_to(np.arange(at, at + len(strip))[:, None], both.shape)))
        order = np.argsort(-sim, axis=0, kind="stable")[:held]
        best, of = np.take_along_axis(sim, order, 0), np.take_along_axis(rows, order, 0)
    for q in range(len(asking)):
        for sim, row in zip(best[:, q], of[:, q], strict=True):
            if sim > 0:
                yield asking["q"][q], having["ids"][row], float(sim)


def nearest(queries: DataFrame, pool: DataFrame, k: int, bits: str = "bits", apart: str | None = None, key: str = "id", most: int = MOST) -> DataFrame:
    """The k of the pool with the largest Tanimoto similarity over 0 to each query; ties go to the smaller id.

    id, neighbor, sim, k and the pool's other columns.  ``apart``: a column in which the two must differ; without it, they
    must differ in their id.  Rows without features have no neighbours.  ``most``: how many classes of the pool may have a
    feature that is joined; a query meets at most that many by each of its features.
    """
    held = k + 1  # one of them may be the query itself
    extra = [c for c in pool.columns if c not in (key, bits, apart)]
    pooled = staged(classes(pool, bits, apart, key, held), "pool-classes")
    asked = staged(classes(queries, bits, apart, key, None), "query-classes")
    counts = pooled.select(F.explode("b").alias("f")).groupBy("f").agg(F.count("*").alias("df"))
    features = staged(asked.select(F.col("c").alias("q"), "a", F.explode("b").alias("f")).join(counts, "f"), "query-features")
    best, waiting, lower = None, None, 0
    for upto in (RARE, most):
        here = features.where((F.col("df") > lower) & (F.col("df") <= upto))
        if waiting is not None:
            here = here.join(waiting.select("q"), "q", "left_semi")
        found = _met(here, asked, pooled, waiting, apart, held)
        best = staged(_best(found if best is None else best.unionByName(found), held), "best")
        waiting, lower = staged(_open(features, asked, best, upto, held), "open"), upto
        if waiting.isEmpty():
            break
    else:
        best = _best(best.unionByName(_common(features, asked, pooled, waiting, apart, held, most)), held)
    rows = named(queries, bits, apart, key).select("id", "c").join(best, F.col("c") == F.col("q")).where(F.col("id") != F.col("neighbor"))
    rows = top_per_group(rows.select(F.col("id").alias(key), "neighbor", "sim"), [key], [F.desc("sim"), F.col("neighbor")], k)
    return rows.join(pool.select(F.col(key).alias("neighbor"), *extra), "neighbor").select(key, "neighbor", "sim", "k", *extra)
