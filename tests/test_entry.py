import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["model", "task", "n", "auroc", "ece_conf", "aurc", "sel_acc_50"] and df.count() > 0


def test_oracle_names():
    assert set(e.oracle_sql()) <= set(e.queries())
