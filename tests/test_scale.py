"""Steps that grew faster than their input, or lost exactness with it."""

import random
import time

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from plumbline.functions.sequences import kmers
from plumbline.operators import heads, relational


def test_percentiles_between_equal_values_are_that_value(spark):
    rows = [(f"{n}:{v}", v) for n in range(2, 60) for v in (17.03, 5.1, 33.37) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    for row in relational.percentiles(df, ["g"], "v", [0.9, 1 / 3, 2 / 3]).collect():
        assert row.percentiles == [float(row.g.split(":")[1])] * 3


def test_least_above_is_brute_force(spark):
    rng = random.Random(4)
    pick = lambda: None if rng.random() < 0.05 else float(rng.randrange(12)) / 2
    a = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]), pick()) for _ in range(150)]
    b = [(None if rng.random() < 0.2 else k, rng.choice([None, 1, 2]), pick()) for k in range(25)] + [(None, 3, 9.0)]
    left, right = spark.createDataFrame(a, "k int, g int, v double"), spark.createDataFrame(b, "s int, h int, w double")
    want: dict = {}
    for k, g, v in a:
        for s, h, w in b:
            if None not in (g, h, v, w) and g == h and v < w:
                want.setdefault(k, []).append(s)
    want = {k: min((s for s in found if s is not None), default=None) for k, found in want.items()}
    assert {r.k: r.s for r in relational.least_above(left, "k", "g", "v", right, "s", "h", "w").collect()} == want


def test_first_matching_makes_no_pairs(spark, tmp_path):
    from plumbline.plans import catalog

    n = 4000
    spark.range(n).selectExpr("id c_custkey", "1 c_nationkey", "double(id) c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id s_suppkey", "1 s_nationkey", "double(id) s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalog.QUERIES["q_j4_first_matching"](spark, str(tmp_path))
    assert found.where("s_suppkey = c_custkey + 1").count() == found.count() == n - 1
    assert found._jdf.queryExecution().analyzed().toString().count("c_nationkey") == 0  # both come from the ranked table


def test_kmers_are_brute_force_and_linear(spark):
    texts = ["", "ab", "abc", "a\nb\r\nc", "héllo \U0001f600\U0001f601 x", None, " aáb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in (1, 2, 3):
        assert [r[0] for r in df.select(kmers(F.col("t"), k)).collect()] == [[t[i : i + k] for i in range(len(t) - k + 1)] if t else [] for t in texts]
    long = spark.range(1).select(F.repeat(F.lit("abcd efg"), 40_000).alias("t"))
    began = time.perf_counter()
    assert long.select(F.size(kmers(F.lower("t"), 3))).first()[0] == 319_998
    assert time.perf_counter() - began < 20


def test_tf_idf_and_its_scaling_stay_sparse(spark):
    rows = [(k, f"a{k % 50} b{k % 7} c", k % 2) for k in range(200)]
    df = heads.tf_idf(spark.createDataFrame(rows, "id int, text string, label int"), F.split("text", " "))
    assert all(isinstance(r.features, SparseVector) and len(r.features.indices) <= 3 for r in df.collect())
    model = heads.linear_head(df)
    assert isinstance(model.transform(df).first().scaled, SparseVector)


def test_uncentred_heads_are_those_of_centred_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) + 5
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0).astype(int)
    to = lambda v: heads.vectors(spark.createDataFrame([(int(b), [float(c) for c in a]) for a, b in zip(v, y, strict=True)], "label int, v array<double>"), "v")
    probs = [[r.prob for r in heads.score(heads.linear_head(d), d).collect()] for d in (to(x), to(x - x.mean(0)))]
    assert probs[0] == pytest.approx(probs[1], abs=1e-4)


def test_draws_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from plumbline.operators import sampling

    df = spark.range(600).selectExpr("id", "id % 2 g", "id % 7 / 7D prob", "int(id % 3 = 0) label")
    whole = sorted(map(tuple, sampling.bootstrap_auroc(df, ["g"], 10, 5).collect()))
    monkeypatch.setattr(sampling, "DRAWS_A_TASK", 300)
    _, counts, many = sampling._drawn(df.select("g", "id"), ["g"], "id", 10, 5)
    sizes = counts.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("m").alias("n")).collect()
    assert many and counts.rdd.getNumPartitions() == 20 and max(r.n for r in sizes) < 1000 and sum(r.n for r in sizes) == 6000
    again = sampling.bootstrap_auroc(df, ["g"], 10, 5)
    assert sorted(map(tuple, again.collect())) == whole
    assert "BuildLeft" not in again._jdf.queryExecution().executedPlan().toString()


def test_graphs_are_read_once_and_by_all_tasks(spark):
    from plumbline.operators import graphs

    rows = [(k, None if k % 50 == 0 else "C" * (1 + k % 40)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    found = graphs.fingerprinted(df, "t")
    assert sorted((r.id, r.t, r.bits is None) for r in found.collect()) == [(k, t, t is None) for k, t in rows]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate") < plan.index("RepartitionByExpression")


def test_database_files_follow_rows(spark, monkeypatch):
    from plumbline.sources import databases

    df = spark.range(1000)
    assert databases.files_for(df, df) == 8
    monkeypatch.setattr(databases, "ROWS_A_FILE", 100)
    assert databases.files_for(df, df) == 20
