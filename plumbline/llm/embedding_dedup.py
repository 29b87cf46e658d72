"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t).  Pivots, a bounded sample of the
vectors of every label that has many, cut its vectors into cells by the nearest pivot.  A vector is copied to another cell where the
distances allow it to have a neighbour there: the triangle inequality bounds how near that cell's vectors can be,
from its radius and from the plane midway between the two pivots.  Cells, and vectors of different label or
dimension, are then joined on their own, large cells as pairs of blocks.

Equal vectors are joined once, with their number.  A block pair returns, for each vector, the number of its links
and one link into its group, so the output doesn't grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from plumbline.llm.components import components
from plumbline.llm.storage import collected, written

VECTORS_A_PIVOT = 2048
MOST_PIVOTS = 1024
BLOCK_ROWS = 2048
SLACK = 1e-9

CELL_ROW = "label long, dim int, cell int, home boolean, node long, mult long, vector array<{}>"
LINK_ROW = "node long, links long, root long"


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * x @ pivots.T))


def _component(vectors: DataFrame, column: str) -> str:
    """Single precision is kept as it is; any other number becomes a double."""
    return "float" if isinstance(vectors.schema[column].dataType.elementType, FloatType) else "double"


Key = tuple[int, int]  # label and dimension


def _cells(vectors: DataFrame, pivots: dict[Key, np.ndarray], radius: dict[tuple[int, int, int], float] | None, reach: float) -> DataFrame:
    """Each vector in its own cell and, if radius is given, in those of lower number where it may have a neighbour."""
    held = vectors.sparkSession.sparkContext.broadcast((pivots, radius))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radii = held.value
        for batch in batches:
            keys = pd.Series(list(zip(batch["label"], batch["dim"], strict=True)), index=batch.index, dtype=object)
            many = keys.isin(centres.keys())
            if not many.all():
                yield batch[~many].assign(cell=0, home=True)
            for key, part in batch[many].groupby(keys[many], sort=False):
                p = centres[key]
                d = to_pivots(unit(part["vector"]), p)
                own = d.argmin(axis=1)
                if radii is None:
                    yield part.assign(cell=own, home=True, vector=[[v] for v in d.min(axis=1)])
                    continue
                yield part.assign(cell=own, home=True)
                apart = to_pivots(p, p)
                near = d[np.arange(len(d)), own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - near[:, None] ** 2) / (2 * apart[own])
                limit = np.array([radii.get((*key, j), -np.inf) for j in range(len(p))])
                may = (d <= limit + reach + SLACK) & ~(plane > reach + SLACK) & (np.arange(len(p)) < own[:, None])
                rows, cells = np.nonzero(may)
                if len(rows):
                    yield part.iloc[rows].assign(cell=cells, home=False)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in deal(batches):
            yield out[["label", "dim", "cell", "home", "node", "mult", "vector"]]

    return vectors.mapInPandas(ordered, CELL_ROW.format(_component(vectors, "vector")))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group, under links a[i] - b[i] between 0 .. n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(threshold: float):
    def links(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["node", "home"], kind="stable").reset_index(drop=True)
        x, node, mult = unit(block["vector"]), block["node"].to_numpy(), block["mult"].to_numpy()
        left = np.flatnonzero((block["part"] == block["left"]) & block["home"])
        right = np.flatnonzero(block["part"] == block["right"])
        home = block["home"].to_numpy()
        count = np.zeros(len(block), np.int64)
        pairs_a, pairs_b = [], []
        for k in range(0, len(left), 512):
            rows = left[k : k + 512]
            i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
            i, j = rows[i], right[j]
            # of two vectors at home here each meets the other once; a guest meets those at home
            ok = (node[i] < node[j]) | ~home[j]
            i, j = i[ok], j[ok]
            np.add.at(count, i, mult[j])
            np.add.at(count, j, mult[i])
            root = _roots(len(block), i, j)
            pairs_a.append(np.arange(len(block)))
            pairs_b.append(root)
        root = _roots(len(block), np.concatenate(pairs_a), np.concatenate(pairs_b)) if pairs_a else np.arange(len(block))
        out = pd.DataFrame({"node": node, "links": count, "root": node[root]})
        return out[out["links"] > 0]

    return links


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, their dimensions are equal, and their cosine, in double
    precision, is at least ``threshold``.  Labels may be of any type; they are compared by a 64-bit hash.  A vector that is null, empty, zero, or has a null or non-finite component
    links with nothing: its n_links is 0 and its component its own id.  component_id is the smallest id reachable,
    kept says that it is the row's own.  Ids should be unique; rows that share one count as separate vectors.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    vector = F.col(vector_col)
    sound = vector.isNotNull() & F.col(label_col).isNotNull() & F.exists(vector, lambda v: v != 0)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = written(
        vectors.select(
            F.col(id_col).alias("id"),
            F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col)).alias("label"),
            F.when(F.coalesce(sound & finite, F.lit(False)), vector.cast(f"array<{_component(vectors, vector_col)}>")).alias("vector"),
        ).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")}),
        "vectors",
    )
    usable = rows.where("vector is not null")
    # equal vectors have equal keys, of 128 bits
    distinct = written(
        usable.groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("vector").alias("vector")).withColumns({"dim": F.size("vector"), "node": F.monotonically_increasing_id()}),
        "vectors-distinct",
    )
    n = distinct.count()
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    each = max(VECTORS_A_PIVOT, -(-n // MOST_PIVOTS))
    large = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > each).withColumn("wanted", F.ceil(F.col("n") / each))
    # a label has at most a pivot more than its share, so 2 * MOST_PIVOTS in all; twice as many are drawn, and the first taken
    drawn = distinct.join(F.broadcast(large), ["label", "dim"]).where(F.pmod("k2", F.col("n")) < 2 * F.col("wanted"))
    pivots = {}
    for key, part in pd.DataFrame(collected(drawn.select("label", "dim", "k2", "wanted", "vector"))).groupby(["label", "dim"]):
        pivots[tuple(map(int, key))] = unit(part.sort_values("k2")["vector"].iloc[: int(part["wanted"].iloc[0])])

    bare = distinct.select("label", "dim", "node", "mult", "vector")
    radius: dict[tuple[int, int, int], float] = {}
    if pivots:
        known = F.broadcast(large.select("label", "dim"))
        far = _cells(bare.join(known, ["label", "dim"], "left_semi"), pivots, None, reach).where(F.size("vector") == 1).groupBy("label", "dim", "cell").agg(F.max(F.col("vector")[0]).alias("d")).collect()  # a row a pivot
        radius = {(r.label, r.dim, r.cell): float(r.d) + 1e-6 for r in far}
    dealt = written(_cells(bare, pivots, radius, reach), "vectors-cells")
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    placed = (
        dealt.join(sizes, ["label", "dim", "cell"])
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    # a block pair (left, right) has the left part's vectors at home and all of the right part
    block = placed.select("*", F.col("part").alias("left"), F.col("other").alias("right")).where("home").unionByName(
        placed.where("part <> other or not home").select("*", F.col("other").alias("left"), F.col("part").alias("right"))
    )
    found = written(
        block.select("label", "dim", "cell", "left", "right", "part", "home", "node", "mult", "vector")
        .groupBy("label", "dim", "cell", "left", "right")
        .applyInPandas(_block_links(threshold), LINK_ROW),
        "vectors-links",
    )
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    # links are between vectors, not ids, which rows may share; a group's id is the smallest of its vectors
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = groups.join(distinct.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    by_class = (
        distinct.select("label", "k1", "k2", "node", "rep", "mult")
        .join(linked, "node", "left")
        .join(groups.join(least, "component").select("node", "least"), "node", "left")
        .select(
            "label",
            "k1",
            "k2",
            (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
            F.coalesce("least", "rep").alias("component"),
        )
    )
    one = F.when(F.col("vector").isNotNull(), F.col("label"))
    return (
        rows.select("id", one.alias("label"), "k1", "k2")
        .join(by_class, ["label", "k1", "k2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )
