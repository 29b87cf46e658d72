"""Fingerprints, scaffolds, fragments and other notations of labelled graphs, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import notation
from plumbline.functions.alignment import mixed
from plumbline.functions.notation import Graph

_BONDS = {"-": 1, "=": 2, "#": 3, ":": 4}


def read(texts: list[str | None]) -> list[Graph | None]:
    """The graph of each text; None of what isn't a notation."""

    def one(text: str | None) -> Graph | None:
        try:
            return notation.parse(text) if text else None
        except ValueError:
            return None

    return [one(t) for t in texts]


def circular_bits(graphs: list[Graph], rings: list[set[tuple[int, int]]], radius: int, size: int) -> list[list[int]]:
    """The bits of all neighbourhoods of up to ``radius`` bonds, all graphs of a batch at once.

    An atom's code is a hash of what it is; each round hashes it with the sum of its neighbours' mixed codes and bonds, so
    the order of atoms has no part in it.
    """
    if not graphs:
        return []
    offset = np.cumsum([0, *(len(g.atoms) for g in graphs)])
    facts = []
    for g, r in zip(graphs, rings, strict=True):
        ringed = {a for bond in r for a in bond}
        for a, x in enumerate(g.atoms):
            letters = [ord(c) for c in x.symbol.ljust(2)]
            facts.append((*letters, x.aromatic, x.charge + 128, x.mass, g.hydrogens(a), len(g.near[a]), a in ringed))
    code = np.zeros(len(facts), np.uint64)
    for column in np.array(facts, np.uint64).T:
        code = mixed(code * np.uint64(31) + column + np.uint64(1))
    bonds = np.array([(offset[k] + a, offset[k] + b, _BONDS[kind]) for k, g in enumerate(graphs) for a, near in enumerate(g.near) for b, kind in near.items()], np.int64).reshape(-1, 3)
    of = np.repeat(np.arange(len(graphs)), np.diff(offset))
    codes = [code]
    for _ in range(radius):
        sent = mixed(code[bonds[:, 1]] + bonds[:, 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gathered = np.zeros_like(code)
        np.add.at(gathered, bonds[:, 0], sent)
        code = mixed(code * np.uint64(31) + mixed(gathered))
        codes.append(code)
    pairs = np.unique(np.concatenate([of * size + (c % np.uint64(size)).astype(np.int64) for c in codes]))
    return [p.tolist() for p in np.split(pairs % size, np.searchsorted(pairs, np.arange(1, len(graphs)) * size))]


def _by_batch(df: DataFrame, column: str, schema: str, made: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """df with further columns, made of one column's texts batch by batch; null where that is null.

    Each distinct text is read once.  Texts are dealt to all tasks, however few files or partitions df has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(column), *made(batch.column(column).to_pylist())], [column, *names])

    names = [c.split()[0] for c in schema.split(", ")]
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = df.select(column).where(F.col(column).isNotNull()).repartition(tasks, column).distinct()  # after it, Spark would leave it out
    return df.join(texts.mapInArrow(run, f"`{column}` string, {schema}"), column, "left").select(*df.columns, *names)


def fingerprinted(df: DataFrame, column: str, radius: int = 2, size: int = 2048) -> DataFrame:
    """df with bits, n_rings, ring_sizes, scaffold and masses of each graph; null where the text isn't a notation.

    bits: hashed neighbourhoods up to ``radius``, as sorted numbers below ``size``.  n_rings: independent rings.
    ring_sizes: sizes that the smallest rings of its bonds have.  scaffold: the notation of its rings and what links them,
    empty without rings, the same whatever the order of atoms.  masses: those of its fragments, in falling order.
    """

    def made(texts: list[str | None]) -> list[pa.Array]:
        graphs = read(texts)
        held = [g for g in graphs if g]
        rings = [notation.ring_bonds(g) for g in held]
        bits = circular_bits(held, rings, radius, size)
        rows = iter(zip(held, rings, bits, strict=True))
        out: list[tuple] = []
        for graph in graphs:
            if graph is None:
                out.append((None,) * 5)
                continue
            g, r, b = next(rows)
            core = notation.scaffold(g, r)
            n = sum(map(len, g.near)) // 2 - len(g.atoms) + len(g.components())
            masses = sorted((round(g.weight(f), 3) for f in notation.fragments(g, r)), reverse=True)
            out.append((b, n, sorted({notation.smallest_ring(g, x, y) for x, y in r}), notation.canonical(g.part(core)) if core else "", masses))
        kinds = [pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.float64())]
        return [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]

    return _by_batch(df, column, "bits array<int>, n_rings int, ring_sizes array<int>, scaffold string, masses array<double>", made)


def renotated(df: DataFrame, column: str, seed: str = "0", tries: int = 8) -> DataFrame:
    """df with ``other``: another notation of the same graph, drawn by the seed and the text.

    Null where the text isn't a notation, has marks of stereochemistry, which depend on the order of atoms, or is the only
    one that so many draws give.
    """

    def one(text: str | None, graph: Graph | None) -> str | None:
        if graph is None or graph.stereo:
            return None
        return next((t for t in (notation.rewritten(graph, f"{seed}:{k}:{text}") for k in range(tries)) if t != text), None)

    return _by_batch(df, column, "other string", lambda texts: [pa.array([one(t, g) for t, g in zip(texts, read(texts), strict=True)], pa.string())])
