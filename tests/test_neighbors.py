"""The top-k similarity join against all pairs, with features that all rows have, hot classes and ties."""

import numpy as np
import pytest

from plumbline.operators import neighbors
from plumbline.operators.neighbors import nearest


def brute(queries, pool, k, apart):
    out = set()
    for i, a, x in queries:
        a = {f for f in a or [] if f is not None}
        sims = []
        for j, b, y in pool:
            b = {f for f in b or [] if f is not None}
            if a & b and ((x is not None and y is not None and x != y) if apart else i != j):
                sims.append((-len(a & b) / len(a | b), j))
        out |= {(i, j, round(-s, 12), n + 1) for n, (s, j) in enumerate(sorted(sims)[:k])}
    return out


def check(spark, queries, pool, k, apart, most, kind="int"):
    schema = f"id int, bits array<{kind}>, x string"
    q, p = spark.createDataFrame(queries, schema), spark.createDataFrame(pool, schema)
    found = nearest(q, p, k, apart="x" if apart else None, most=most).collect()
    assert {(r.id, r.neighbor, round(r.sim, 12), r.k) for r in found} == brute(queries, pool, k, apart)
    assert len(found) == len({(r.id, r.k) for r in found})


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("most", [1, 12, 1000])
def test_nearest_is_brute_force(spark, monkeypatch, apart, most):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "SLICE", 40)
    monkeypatch.setattr(neighbors, "STRIP", 7)
    monkeypatch.setattr(neighbors, "RARE", min(most, 3))
    rng = np.random.default_rng(most)
    rows = []
    for i in range(150):
        own = sorted({0, *map(int, rng.zipf(1.5, int(rng.integers(0, 7))) % 40)})  # feature 0 is everywhere
        rows.append((i, own, "abc"[int(rng.integers(0, 3))]))
    rows += [(200 + i, rows[3][1], "a") for i in range(30)]  # one class of many rows
    rows += [(300, None, "a"), (301, [], "b"), (302, [0], None), (303, [None, 5, 5], "c"), (304, [99], "c"), (305, [0], "a")]
    check(spark, [r for r in rows if r[0] % 3 == 0 or r[0] >= 200], rows, 4, apart, most)


def test_queries_from_elsewhere_and_text_features(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    pool = [(i, list(rng.choice(words, 6)), "p") for i in range(60)]
    queries = [(1000 + i, list(rng.choice([*words, "unknown", "a,b"], 5)), "q") for i in range(20)]
    check(spark, queries, pool, 3, False, 5, "string")


def test_no_common_feature_is_joined(spark):
    """Rows that have nothing but common features meet as combinations: the plan's joins see none of them."""
    rows = [(i, [0, 1 + i % 2], "x") for i in range(400)] + [(400 + i, [0, 10 + i], "y") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, bits array<int>, x string")
    found = nearest(df.where("id < 3"), df, 2, most=10).collect()
    assert {(r.id, r.neighbor, r.sim) for r in found} == {(0, 2, 1.0), (0, 4, 1.0), (1, 3, 1.0), (1, 5, 1.0), (2, 0, 1.0), (2, 4, 1.0)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "id int, bits array<int>, x string")
    some = spark.createDataFrame([(1, [1], "a")], none.schema)
    assert nearest(none, some, 3).isEmpty() and nearest(some, none, 3).isEmpty() and nearest(some, some, 3).isEmpty()
