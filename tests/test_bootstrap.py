"""Draws that are split down a tree, against counts of single draws."""

import numpy as np
import pytest

from plumbline.operators import sampling


def test_draws_are_multinomial_together():
    n, reps = 37, 4000
    whole = sampling.draws_before(np.arange(n + 1), n, reps, (5,))
    m = np.diff(whole, axis=0)
    assert (whole[0] == 0).all() and (m.sum(axis=0) == n).all() and (m >= 0).all()
    assert np.abs(m.mean(axis=1) - 1).max() < 0.08 and np.abs(m.var(axis=1) - (1 - 1 / n)).max() < 0.12
    assert abs(np.corrcoef(m[3], m[20])[0, 1] + 1 / (n - 1)) < 0.06
    some = np.array([0, 4, 4, 11, 30, 37])
    assert (sampling.draws_before(some, n, reps, (5,)) == whole[some]).all()  # whoever asks is told the same
    assert not (sampling.draws_before(some, n, reps, (6,)) == whole[some]).all()
    assert (sampling.draws_before(np.array([0, 1]), 1, 3, (1,)) == [[0, 0, 0], [1, 1, 1]]).all()


def area(p, q):
    """AUROC of counts of positives and negatives by rising score."""
    return ((p * (np.cumsum(q) - q + q / 2)).sum() / (p.sum() * q.sum())) if p.sum() and q.sum() else None


@pytest.mark.parametrize("block", [3, 4096])
def test_replicates_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "SCORES_A_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.integers(0, 25)) / 10, int(rng.integers(0, 2))) for g in ("a", "b", None) for _ in range(90)] + [("one", 0.5, 1)] * 4
    df = spark.createDataFrame(rows, "g string, prob double, label int")
    found = {(r.g, r.rep): r.auroc for r in sampling.split_bootstrap_auroc(df, ["g"], 20, 7).collect()}
    keys = {r.g: r.k for r in df.selectExpr("g", "xxhash64(7, g) k").distinct().collect()}
    assert len(found) == 4 * 20
    for g in ("a", "b", None, "one"):
        own = sorted((s, 1 - y) for h, s, y in rows if h == g)
        m = np.diff(sampling.draws_before(np.arange(len(own) + 1), len(own), 20, (keys[g] & (1 << 64) - 1,)), axis=0)
        scores = sorted({s for s, _ in own})
        for rep in range(20):
            p, q = (np.array([sum(m[k, rep] for k, (s, y) in enumerate(own) if s == t and y == side) for t in scores]) for side in (0, 1))
            want = area(p, q)
            assert found[g, rep] == (None if want is None else pytest.approx(want)) or want is None and np.isnan(found[g, rep])


def test_interval_is_that_of_plain_resampling(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    s = np.round(y * 0.6 + rng.normal(size=400), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "prob double, label int")
    found = [r.auroc for r in sampling.split_bootstrap_auroc(df, [], 600, 3).collect()]
    plain = []
    for _ in range(600):
        at = rng.integers(0, 400, 400)
        a, b = s[at][y[at] == 1], s[at][y[at] == 0]
        plain.append(((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2))
    assert np.percentile(found, [2.5, 50, 97.5]) == pytest.approx(np.percentile(plain, [2.5, 50, 97.5]), abs=0.012)
