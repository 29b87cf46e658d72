import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing as p
from plumbline.functions import perturbation as x
from plumbline.operators import relational as r
from plumbline.operators import routing
from plumbline.operators import sampling as s
from plumbline.operators import solver
from plumbline.sources import readers, sinks
from plumbline.streaming import scorecard


def test_probability_answers(spark):
    said = {"-0.3": 0.3, "1e-5": 0.05, "85%": 0.85, "none": 0.5, "150 then 0.2": 0.2, "0.2 then 150": 0.2, "": 0.5, None: 0.5, "1": 1.0, "100": 1.0}
    df = spark.createDataFrame([(a,) for a in said], "a string").select("a", p.probability(F.col("a")).alias("v"))
    assert {row.a: row.v for row in df.collect()} == said


def test_strings_of_broken_json(spark):
    df = spark.createDataFrame([('x ["a", "b"] y',), ('["a", "b"',), ("none",)], "a string")
    assert [row[0] for row in df.select(p.strings(F.col("a"))).collect()] == [["a", "b"], ["a", "b"], []]


def test_scramble_keeps_characters(spark):
    row = spark.createDataFrame([("hello world",)], "t string").select(x.scramble(F.col("t"), 1), x.scramble_different(F.lit("aa"), 1)).first()
    assert sorted(row[0]) == sorted("hello world") and row[1] == "aa"


def test_derangement_has_no_fixed_point(spark):
    out = r.derangement(spark.range(50), "id", 1).collect()
    assert len(out) == 50 and all(row.id != row.other for row in out) and len({row.other for row in out}) == 50


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    out = r.ranked(df, ["g"], ["v"], parts=7).collect()
    for g in range(3):
        rows = sorted((row.v, row["rank"]) for row in out if row.g == g)
        assert [k for _, k in rows] == list(range(1, len(rows) + 1))


def test_balanced_sample(spark):
    df = spark.range(100).select("id", (F.col("id") < 20).cast("int").alias("label"))
    n = {row.label: row["count"] for row in s.balanced(df, 1000, 3).groupBy("label").count().collect()}
    assert n == {0: 20, 1: 20}


def test_group_folds_keep_groups(spark):
    df = s.group_folds(spark.range(200).select("id", (F.col("id") % 17).cast("string").alias("grp")), 4, 1)
    assert df.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_greedy_partitions():
    assert s.greedy_folds({"a": 5, "b": 4, "c": 3, "d": 2}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    parts = s.two_pass_partition({"a": (3, 5), "b": (2, 4), "c": (0, 6), "d": (0, 1)}, 2)
    assert parts["a"] != parts["b"] and set(parts) == {"a", "b", "c", "d"}


def test_bootstrap_draws_n_units(spark):
    units = spark.range(30).select(F.lit("x").alias("k"), "id")
    out = s.multiplicities(units, ["k"], "id", 5, 1).groupBy("rep").agg(F.sum("m").alias("n")).collect()
    assert [row.n for row in out] == [30] * 5


def test_oracle_beats_policies(spark):
    data = [(i, i % 2, (i // 2) % 2, (i % 10) / 10, "SELF" if i % 3 else "DEFER") for i in range(60)]
    df = spark.createDataFrame(data, "id int, err int, spec_err int, conf double, route string").withColumn("g", F.lit(0))
    row = routing.policies(df, ["g"]).first()
    assert all(row.oracle >= row[c] - 1e-9 for c in ("always_model", "always_spec", "own_defer", "conf_route"))


def test_provider_failures_are_rows(spark):
    def broken(model, prompt):
        raise ValueError("no")

    assert solver.answer(broken, "m", "p", tries=2, pause=0) == (None, "err:ValueError")
    providers = solver.Providers()
    providers.insert(lambda m: m == "x", lambda m, q: "I cannot say")
    out = solver.solve(spark.createDataFrame([(1, "a")], "id int, prompt string"), "x", providers).first()
    assert out.status == "refusal" and providers.of("y") is solver.offline


def test_fasta_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sp|P1|x GN=G1 z\nABC\nDE\n>q TARGET=3.5\nFF\n")
    out = {row.acc: (row.gene, row.sequence) for row in readers.fasta_proteins(spark, str(tmp_path / "a.fa")).collect()}
    assert out["P1"] == ("G1", "ABCDE")
    assert {row.target for row in readers.fasta_targets(spark, str(tmp_path / "a.fa")).collect()} == {None, 3.5}


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x00\x01")
    assert readers.images(spark, str(tmp_path / "*.png")).first().content == "AAE="


def test_upsert_replaces(spark):
    old, new = (spark.createDataFrame(d, "model string, task string, v int") for d in ([("a", "t", 1), ("a", "u", 2)], [("a", "t", 9)]))
    assert {(row.task, row.v) for row in sinks.merge_scorecards(old, new).collect()} == {("t", 9), ("u", 2)}


def test_stream_keeps_newest(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for k in (1, 2):
        spark.createDataFrame([("a", "t", k)], "model string, task string, v int").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("model string, task string, v int").parquet(str(src))
        scorecard.keep_scorecard(stream, str(out), str(tmp_path / "cp"), ["model", "task"]).awaitTermination()
    assert [row.v for row in spark.read.parquet(f"{out}/version=1").collect()] == [2]


def test_median_binarized_needs_two_classes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    out = {(row.g, row.v, row.label) for row in r.median_binarized(df, ["g"], "v").collect()}
    assert out == {("a", 1.0, 0), ("a", 5.0, 1)}


@pytest.mark.parametrize("n", [1, 2, 9])
def test_systematic(spark, n):
    out = r.systematic(spark.range(100).withColumnRenamed("id", "v"), ["v"], n).collect()
    assert sorted(row.v for row in out) == [int(i * 100 / n) for i in range(n)]


def test_ranks_of_a_wide_table_in_many_partitions(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 16).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    numbered = r.ranked(df, ["label"], [F.xxhash64("id"), "id"], total="n")
    seen = numbered.groupBy("label").agg(F.count_distinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("z"), F.max("n").alias("n"), F.count("*").alias("c")).collect()
    assert sum(row.c for row in seen) == n and all((row.a, row.z, row.d, row.n) == (1, row.c, row.c, row.c) for row in seen)
    assert s.shuffled_labels(df, 3).count() == n


def test_ranks_with_null_keys_and_running_sums(spark):
    df = spark.createDataFrame([(k, i, float(i % 4)) for i, k in enumerate([None, "a", "a", None, "b"] * 20)], "k string, v int, x double")
    out = r.ranked(df, ["k"], [F.desc("v")], sums={"upto": F.col("x")}, parts=5).collect()
    for k in (None, "a", "b"):
        rows = sorted((row for row in out if row.k == k), key=lambda row: -row.v)
        assert [row["rank"] for row in rows] == list(range(1, len(rows) + 1))
        assert [row.upto for row in rows] == [sum(q.x for q in rows[: i + 1]) for i in range(len(rows))]


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.integers(0, 5, 40).tolist(), "b": rng.normal(size=31).tolist(), None: [2.5]}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None)], "k string, v double")
    shares = [0.0, 1 / 3, 0.5, 0.9, 1.0]
    out = {row.k: row.p for row in r.percentiles(df, ["k"], "v", shares, "p").collect()}
    assert set(out) == set(data) and all(out[k] == pytest.approx(np.quantile(x, shares).tolist()) for k, x in data.items())


def test_one_long_group_is_dealt_to_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("g"), F.col("id").alias("at"), (F.col("id") % 7 == 0).alias("head")).unionByName(
        spark.createDataFrame([("few", 1, True), ("few", 2, None), ("few", 3, False)], "g string, at long, head boolean")
    )
    out = r.sections(rows, ["g"], ["at"], F.col("head")).withColumn("part", F.spark_partition_id())
    assert out.where("g = 'all'").select("part").distinct().count() > 1
    assert out.where("(g = 'all' and section <> floor(at / 7) + 1) or (g = 'few' and section <> 1)").isEmpty() and out.count() == 20_003
    assert sorted((x.g, x.at) for x in r.to_common_length(rows, ["g"], ["at"]).collect()) == [("all", 0), ("all", 1), ("all", 2), ("few", 1), ("few", 2), ("few", 3)]
