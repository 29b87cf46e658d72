import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as m


@pytest.fixture(scope="module")
def frame(spark):
    data = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.3, 0), (5, 0.3, 0), (6, 0.1, 1)]
    return spark.createDataFrame(data, "id int, prob double, label int").withColumn("g", F.lit("a"))


def value(df, name):
    return df.first()[name]


def test_auroc_by_hand(frame):
    # pairs won, ties half: 0.9 beats 3; 0.8 ties one and beats two; 0.1 beats none
    assert value(m.auroc(frame, ["g"]), "auroc") == pytest.approx((3 + 2.5 + 0) / 9)


def test_auroc_flips(frame):
    flipped = frame.withColumn("prob", 1 - F.col("prob"))
    assert value(m.auroc(frame, ["g"]), "auroc") + value(m.auroc(flipped, ["g"]), "auroc") == pytest.approx(1)


def test_auroc_of_monotone_map(frame):
    mapped = frame.withColumn("prob", F.exp(3 * F.col("prob")))
    assert value(m.auroc(mapped, ["g"]), "auroc") == pytest.approx(value(m.auroc(frame, ["g"]), "auroc"))


def test_one_class_is_null(frame):
    assert value(m.auroc(frame.where("label = 1"), ["g"]), "auroc") is None


def test_weights_are_copies(frame):
    twice = frame.unionByName(frame.where("id <= 3"))
    weighed = frame.withColumn("w", F.when(F.col("id") <= 3, 2).otherwise(1))
    assert value(m.auroc(twice, ["g"]), "auroc") == pytest.approx(value(m.auroc(weighed, ["g"], weight=F.col("w")), "auroc"))


def test_bins_follow_float_edges(spark):
    # 3 * 0.1 is above 0.3, so 0.3 lies in the bin below that edge
    x = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.35,), (1.0,)], "x double").select(m.upper_bin(F.col("x")), m.lower_bin(F.col("x"))).collect()
    assert [r[0] for r in x] == [None, 0, 2, 3, 9]
    assert [r[1] for r in x] == [0, 1, 3, 3, 9]


def test_oracle_order_is_best(frame):
    err = F.col("label")
    best = value(m.aurc(frame, ["g"], 1 - F.col("label"), err), "aurc")
    assert best <= value(m.aurc(frame, ["g"], F.col("prob"), err), "aurc")


def test_expected_aurc_is_the_mean_over_tie_orders(spark):
    f = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id int, err int").withColumn("g", F.lit(0)).withColumn("c", F.lit(0.5))
    orders = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    mean = sum(sum(sum(o[: k + 1]) / (k + 1) for k in range(3)) / 3 for o in orders) / 3
    assert value(m.aurc_expected(f, ["g"], F.col("c"), F.col("err")), "aurc") == pytest.approx(mean)


def test_temperature_of_calibrated_scores_is_near_one(spark):
    data = [(p / 10, int(k < p)) for p in range(1, 10) for k in range(10)]
    f = spark.createDataFrame(data, "prob double, label int").withColumn("g", F.lit(0))
    assert value(m.temperature(f, ["g"]), "temperature") == pytest.approx(1, abs=0.1)
