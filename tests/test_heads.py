"""Learned heads find what is there, and nothing where nothing is."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import heads as h
from plumbline.operators import linear
from plumbline.operators import metrics as m
from plumbline.operators import sampling as s
from plumbline.plans import catalog
from tests.conftest import SF


def points(spark, n=400, seed=0):
    """Label by the first of four numbers; grp in tens; layers of two."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    label = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(int(k), int(label[k]), int(k % 10), x[k].tolist()) for k in range(n)]
    return h.vectors(spark.createDataFrame(rows, "id int, label int, grp int, v array<double>"), "v")


def value(df):
    return df.first()[0]


def test_linear_head_weighs_the_right_number(spark):
    model = h.linear_head(points(spark).drop("v"))
    c = np.abs(model.stages[-1].coefficients.toArray())
    assert c[0] > 5 * c[1:].max()


def test_out_of_fold_scores_signal_and_not_noise(spark):
    d = points(spark).drop("v").withColumn("fold", F.col("id") % 5)
    scored = h.out_of_fold(d, 5)
    assert scored.count() == 400 and value(m.auroc(scored, [])) > 0.93
    noise = s.shuffled_labels(d, 5).drop("label").withColumnRenamed("shuffled", "label")
    assert 0.38 < value(m.auroc(h.out_of_fold(noise, 5), [])) < 0.62
    assert value(m.auroc(h.out_of_fold(d, 5, h.forest_head), [])) > 0.9


def test_fits_of_many_steps_have_few_tasks(spark, monkeypatch):
    d = points(spark).drop("v").withColumn("fold", F.col("id") % 2).repartition(64)
    seen = []

    def probe(df):
        seen.append(df.rdd.getNumPartitions())
        return h.linear_head(df)

    assert sorted(r.id for r in h.out_of_fold(d, 2, probe).select("id").collect()) == list(range(400))
    assert len(seen) == 2 and max(seen) <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(h, "ROWS_A_TASK", 50)  # more rows, more tasks
    more = h.few_parts(d, "parts")
    assert more.rdd.getNumPartitions() <= 8 and sorted(map(str, more.collect())) == sorted(map(str, d.collect()))


def test_gate_passes_signal_only(spark):
    d = s.shuffled_labels(points(spark).drop("v"), 3)
    row = h.gate(d, 3, F.col("id") % 3, F.col("grp") % 3, "shuffled").first()
    assert row.verdict == "PASS" and row.cold > 0.9 and abs(row.leakage_drop) < 0.1
    flipped = d.drop("label").withColumn("label", F.col("shuffled"))
    assert h.gate(flipped, 3, F.col("id") % 3, F.col("grp") % 3, "shuffled", forest=False).first().verdict == "FAIL"


def layered(spark):
    d = points(spark).withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.slice("v", 2 * k + 1, 2).alias("w")) for k in range(2)])))
    return h.vectors(d.select("id", "label", "p.layer", "p.w"), "w").drop("w").withColumn("fold", F.col("id") % 3)


def test_layers_are_told_apart(spark):
    d = layered(spark)
    labels = s.shuffled_labels(d.select("id", "label").distinct(), 2).select("id", "shuffled")
    out = {r.layer: r for r in h.layer_selectivity(d.join(labels, "id"), [0, 1], 3, "shuffled").collect()}
    assert out[0].selectivity > 0.3 > out[1].selectivity and out[0].selectivity == pytest.approx(out[0].auroc - out[0].control)
    nested = h.nested_layer(d, [0, 1], 3).collect()
    assert [r.layer for r in nested] == [0, 0, 0] and all(0 in r.band and r.pooled > 0.9 for r in nested)


def test_tf_idf_is_the_formula(spark):
    texts = ["a b b", "a c", "a b c d", "d e"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    out = h.tf_idf(d, F.split("text", " "), least=2).withColumn("x", vector_to_array("features")).collect()
    df = {w: sum(w in t.split() for t in texts) for w in "abcd"}
    for row in out:
        words = row.text.split()
        raw = sorted(words.count(w) * (math.log(5 / (1 + n)) + 1) for w, n in df.items())
        size = math.sqrt(sum(v * v for v in raw)) or 1.0
        assert sorted(row.x) == pytest.approx([v / size for v in raw])


def test_renderings_of_text(spark):
    d = spark.createDataFrame([(k, "red red blue" if k % 2 else "green blue", k % 2, 0) for k in range(40)], "id int, text string, label int, grp int").withColumn("fold", F.col("id") % 4)
    for features in (h.hashed_ngrams(d, F.split("text", " "), 64), h.bag_of_tokens(d, F.split("text", " "), 10)):
        assert value(m.auroc(h.out_of_fold(features.drop("text"), 2, fold="fold"), [])) == 1.0
    bag = h.bag_of_tokens(d, F.split("text", " "), 10).select(F.array_max(vector_to_array("features"))).distinct().collect()
    assert [r[0] for r in bag] == [1.0]


def test_principal_components_keep_signal_and_clusters_are_found(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 5, (10 * np.eye(5)[k % 5] + rng.normal(scale=0.1, size=5)).tolist()) for k in range(200)]
    d = h.vectors(spark.createDataFrame(rows, "id int, label int, v array<double>"), "v").drop("v")
    pairs = h.cluster_groups(d).select("label", "grp").distinct().collect()
    assert len(pairs) == 5 and len({r.grp for r in pairs}) == 5
    two = points(spark).drop("v").withColumn("fold", F.col("id") % 2)
    assert value(m.auroc(h.out_of_fold(h.principal(two, 4), 2), [])) > 0.93


def test_transfer_and_ensemble(spark):
    a, b = points(spark).drop("v"), points(spark, seed=1).drop("v")
    row = h.transfer(a, b).first()
    assert row.band == "transfers" and row.nt == pytest.approx((row.transfer - 0.5) / (row.in_domain - 0.5))
    draws = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3)) for k in range(3)])
    scored = h.ensemble(a, b, draws, 3)
    assert value(m.auroc(scored, [], "score")) > 0.9
    bold = h.ensemble(a, b, draws, 3, pessimism=0.0).withColumnRenamed("score", "bold")
    assert scored.join(bold, "id").where("score > bold + 1e-12").isEmpty()


def test_learned_router_is_between_its_arms(spark):
    row = catalog.QUERIES["q_r5_learned_router"](spark, SF).first()
    assert 0 <= row.self_share <= 1 and 0.3 < row.routed <= 1


def plain_folds(sizes, k):
    loads, out = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[g] = min(range(k), key=lambda b: (loads[b], b))
        loads[out[g]] += sizes[g]
    return out


def test_greedy_queries_are_brute_force(spark):
    items = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    sizes, positives = {}, {}
    for r in items:
        sizes[r.source] = sizes.get(r.source, 0) + 1
        positives[r.source] = positives.get(r.source, 0) + r.toxic
    folds = plain_folds(sizes, 5)
    want = sorted((f, sum(n for g, n in sizes.items() if folds[g] == f), sum(x == f for x in folds.values())) for f in set(folds.values()))
    assert sorted((r.fold, r.n, r.n_groups) for r in catalog.QUERIES["q_x6_greedy_folds"](spark, SF).collect()) == want
    frozen = {r.id for r in catalog.QUERIES["q_x8_frozen_test_fold"](spark, SF).collect()}
    assert frozen == {r.doc_id for r in items if folds[r.source] == 0}
    blocks, loads = {}, [[0, 0] for _ in range(3)]
    for with_positives in (True, False):
        for g in sorted((g for g in sizes if bool(positives[g]) == with_positives), key=lambda g: (-positives[g], -sizes[g], g)):
            b = min(range(3), key=lambda b: (*loads[b], b) if with_positives else (loads[b][1], b))
            blocks[g] = b
            loads[b] = [loads[b][0] + positives[g], loads[b][1] + sizes[g]]
    got = sorted((r.block, r.n, r.positives) for r in catalog.QUERIES["q_x9_two_pass_partition"](spark, SF).collect())
    assert got == sorted((b, n, p) for b, (p, n) in enumerate(loads) if n)


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(s, "GROUPS_ON_DRIVER", 5)
    with pytest.raises(ValueError, match="group_folds"):
        s.group_sums(spark.range(10).withColumn("g", F.col("id").cast("string")), "g", F.count("*"))


def test_dataset_card_digest_is_of_rows_in_any_order(spark):
    from plumbline.sources import sinks

    df = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "id int, text string")
    card = json.loads(sinks.dataset_card(df, "n", "d"))
    assert card == json.loads(sinks.dataset_card(df.orderBy(F.desc("id")), "n", "d")) and card["rows"] == 20
    assert card["digest"] != json.loads(sinks.dataset_card(df.where("id < 19"), "n", "d"))["digest"]
    assert [f["name"] for f in card["field"]] == ["id", "text"]


# ---- many heads at once -----------------------------------------------------------------------------------------


def plain_head(x, y, c=1.0):
    """Newton on all rows in memory: mean, deviation, coefficients, intercept."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack(((x - mean) / scale, np.ones(len(y))))
    s = len(y) / (2 * np.bincount(y, minlength=2))[y]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(c * (z.T * (s * p * (1 - p))) @ z + np.diag([*np.ones(len(w) - 1), 0]), c * z.T @ (s * (p - y)) + np.append(w[:-1], 0))
        w = w - step
    return mean, scale, w[:-1], w[-1]


def test_arms_are_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.normal(size=(500, 5)) * [1, 100, 1e-3, 1, 1] + [0, 1e4, 0, 0, 0], np.full(500, 0.1)))
    y = (x[:, 0] + 0.5 * rng.normal(size=500) > 0.7).astype(int)
    other = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(k, int(y[k]), int(other[k]), k % 4, x[k].tolist()) for k in range(500)], "id int, label int, other int, fold int, features array<double>").repartition(7)
    arms = [linear.Arm(F.col("fold") != k, F.col(c)) for k in range(4) for c in ("label", "other")]
    arms += [linear.Arm(F.lit(True), F.lit(1)), linear.Arm(F.lit(False), F.col("label")), linear.Arm(F.col("label") == 0, F.col("label"))]
    heads = linear.fit(df, arms)
    for a, head in enumerate(heads[:8]):
        own = np.arange(500) % 4 != a // 2
        want = plain_head(x[own], (other if a % 2 else y)[own])
        assert np.allclose(head.coef, want[2], atol=1e-6) and head.intercept == pytest.approx(want[3], abs=1e-6)
        assert np.allclose(head.mean, want[0]) and np.allclose(head.scale[:5], want[1][:5])
    out = linear.scored(df, heads).orderBy("id").select("probs").toPandas()["probs"]
    probs = np.stack(out.to_list())
    assert (probs[:, 8] > 0.999).all() and (probs[:, 9] == 0.5).all() and (probs[:, 10] < 0.001).all()
    assert np.allclose(probs[:, 0], 1 / (1 + np.exp(-heads[0].log_odds(x))))


def test_separable_rows_are_fitted(spark):
    rows = [(k, int(k >= 20), [float(k) ** 3, 1.0]) for k in range(40)]
    head = linear.fit(spark.createDataFrame(rows, "id int, label int, features array<double>"), [linear.Arm(F.lit(True), F.col("label"))])[0]
    x = np.array([r[2] for r in rows])
    want = plain_head(x.copy(), np.array([r[1] for r in rows]))
    assert np.allclose(head.coef, want[2], atol=1e-6) and head.intercept == pytest.approx(want[3], abs=1e-6)


def test_nested_layer_is_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 6))
    y = (x[:, 2] + 0.8 * rng.normal(size=240) > 0).astype(int)
    fold = rng.integers(0, 4, 240)
    rows = [(k, int(y[k]), int(fold[k]), n, x[k, 2 * n : 2 * n + 2].tolist()) for k in range(240) for n in range(3)]
    df = spark.createDataFrame(rows, "id int, label int, fold int, layer int, features array<double>")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("nested"))
    spark.sparkContext.setJobGroup("nested", "nested")
    found = {r.fold: r for r in h.nested_layer(df, [0, 1, 2], 4).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs() <= 40  # not one for each of the 30 heads and their steps

    def area(s, y):
        return np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])

    def prob(train, n):
        mean, scale, w, b = plain_head(x[train, 2 * n : 2 * n + 2], y[train])
        return 1 / (1 + np.exp(-(((x[:, 2 * n : 2 * n + 2] - mean) / scale) @ w + b)))

    pooled = np.zeros(240)
    for k in range(4):
        curve = []
        for n in range(3):
            s = np.zeros(240)
            for j in range(4):
                s[fold == j] = prob((fold != k) & (fold != j), n)[fold == j]
            curve.append(area(s[fold != k], y[fold != k]))
        best = int(np.argmax(curve))
        pooled[fold == k] = prob(fold != k, best)[fold == k]
        error = np.std(curve, ddof=1) / np.sqrt(3)
        assert found[k].layer == best and found[k].band == [n for n in range(3) if curve[n] >= curve[best] - error]
        assert found[k].auroc == pytest.approx(area(pooled[fold == k], y[fold == k]), abs=1e-6)
    assert found[0].pooled == pytest.approx(area(pooled, y), abs=1e-6)
