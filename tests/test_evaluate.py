"""Runs, sources of odd formats, and solvers."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.evaluate import evaluate, main
from plumbline.operators import metrics as m
from plumbline.operators import sampling as s
from plumbline.operators import solver
from plumbline.sources import readers
from plumbline.streaming import scorecard


def items(spark):
    rows = [(k, "a" if k < 60 else "b", f"{k} {'good' if k % 2 else 'bad'}", k % 2, None if k % 4 < 2 else "scrambled") for k in range(120)]
    return spark.createDataFrame(rows, "id int, task string, representation string, label int, condition string")


def knows(model, prompt):
    return f"Probability: {0.9 if 'good' in prompt else 0.1}"


def test_a_run_is_scored_and_merged(spark, tmp_path):
    providers = solver.Providers()
    providers.insert(lambda name: name == "wise", knows)
    folder = str(tmp_path / "runs")
    one = evaluate(items(spark), [solver.TaskSpec("a", prompt="Is {rep}?", ceiling=0.5)], "wise", 40, 1, providers, folder).collect()
    assert [(r.model, r.task, r.auroc, r.of_ceiling, r.n) for r in one] == [("wise", "a", 1.0, 2.0, 30)] and one[0].memo_delta == 0.0
    assert (one[0].auroc_lo, one[0].auroc_hi, one[0].aurc, one[0].sel_acc_50, one[0].gap) == (1.0, 1.0, 0.0, 1.0, -0.5)
    both = evaluate(items(spark), [solver.TaskSpec("b", orient="oppose")], "wise", 40, 1, providers, folder, workers=3).collect()
    assert sorted((r.task, r.auroc) for r in both) == [("a", 1.0), ("b", 0.0)]
    assert {(r.task, r.aurc, r.sel_acc_50, r.auroc_hi) for r in both} == {("a", 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 0.0)}
    stamps = spark.read.json(f"{folder}/run=*/manifest").collect()
    assert {r.model for r in stamps} == {"wise"} and all(r.commit and r.date_utc.endswith("Z") for r in stamps)


def test_the_command_line(spark, tmp_path, capsys):
    path = tmp_path / "items.jsonl"
    path.write_text("".join(json.dumps({"id": str(k), "property": "p", "representation": f"x{k}", "label": str(k % 2)}) + "\n" for k in range(30)))
    main([str(path), "--tasks", "p", "--n", "20"])
    assert "dry" in capsys.readouterr().out


def test_any_metric_under_the_bootstrap(spark):
    df = spark.createDataFrame([(k, "t", k % 3 == 0, True) for k in range(60)], "id int, task string, pred boolean, label boolean")
    out = s.bootstrap(df, ["task"], 30, 2, lambda rows, by, w: m.accuracy(rows, by, weight=w)).collect()
    assert len(out) == 30 and abs(np.mean([r.accuracy for r in out]) - 1 / 3) < 0.05 and len({r.accuracy for r in out}) > 5


def test_expected_risk_has_no_row_for_each_rank(spark):
    rng = np.random.default_rng(5)
    conf, err = rng.integers(0, 4, 900) / 4, rng.integers(0, 2, 900)
    df = spark.createDataFrame([(k, float(c), int(e)) for k, (c, e) in enumerate(zip(conf, err, strict=True))], "id int, conf double, err int")
    want, n0, e0 = 0.0, 0, 0.0
    for c in sorted(set(conf), reverse=True):
        n, e = int((conf == c).sum()), float(err[conf == c].sum())
        want += sum((e0 + e * j / n) / (n0 + j) for j in range(1, n + 1))
        n0, e0 = n0 + n, e0 + e
    assert m.aurc_expected(df, [], F.col("conf"), F.col("err")).first().aurc == pytest.approx(want / 900, rel=1e-12)


def test_arrays_of_compressed_files(spark, tmp_path):
    x, y = np.arange(12, dtype=np.float32).reshape(6, 2), np.arange(6)
    held = io.BytesIO()
    np.savez_compressed(held, X=x, y=y, other=np.zeros(3))
    (tmp_path / "one.npz").write_bytes(held.getvalue())
    out = readers.npz_rows(spark, f"file://{tmp_path}/*.npz", "X array<float>, y long").orderBy("i").collect()
    assert [r.X for r in out] == x.tolist() and [r.y for r in out] == y.tolist()


def test_rows_of_a_database_joined_three_ways(spark):
    url = "jdbc:derby:memory:plumbline;create=true"
    tables = {"A": [(1, 10), (2, 20), (3, 30)], "B": [(10, 100), (20, 200)], "C": [(100, "x"), (200, "y")]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, f"k int, v {'string' if name == 'C' else 'int'}").write.format("jdbc").options(url=url, dbtable=name).mode("overwrite").save()
    a, b, c = (readers.jdbc_rows(spark, url, name).toDF(f"{name}k", f"{name}v") for name in tables)
    out = a.join(b, a.Av == b.Bk).join(c, b.Bv == c.Ck).select("Ak", "Cv").collect()
    assert sorted(map(tuple, out)) == [(1, "x"), (2, "y")]


def test_headers_and_records_of_several_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#id\tname\n1\tx\n")
    (tmp_path / "b.tsv").write_text("#name\tid\ny\t2\n")
    assert sorted(map(tuple, readers.tsv_rows(spark, f"{tmp_path}/*.tsv", ["id", "name"]).collect())) == [("1", "x"), ("2", "y")]
    (tmp_path / "f.fa").write_text(">a b>c\nAC\nGT\n>d\nTT\n")
    assert sorted(map(tuple, readers.fasta(spark, f"{tmp_path}/f.fa").collect())) == [("a b>c", "ACGT"), ("d", "TT")]
    (tmp_path / "q.csv").write_text('id,t\n1,"two\nlines"\n')
    assert readers.csv_rows(spark, f"{tmp_path}/q.csv", line_feeds=True).first().t == "two\nlines"


def test_answers_of_every_kind():
    said = iter(["", ("cut", "length"), ("no", "refusal"), "I can't", "fine"])
    assert [solver.answer(lambda model, prompt: next(said), "m", "p")[1] for _ in range(5)] == ["empty", "truncated", "refusal", "refusal", "ok"]


def test_a_scorecard_keeps_the_newest_row(spark, tmp_path):
    source, rows = str(tmp_path / "in"), "model string, score int, at timestamp"
    at = lambda k: F.timestamp_seconds(F.lit(k))
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "model string, score int").withColumn("at", at(100) + F.make_interval(secs=F.col("score"))).coalesce(1).write.parquet(f"{source}/one")
    stream = spark.readStream.schema(rows).parquet(f"{source}/*")
    scorecard.keep_scorecard(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["model"], "at").awaitTermination()
    assert sorted((r.model, r.score) for r in spark.read.parquet(str(tmp_path / "out/version=0")).collect()) == [("a", 2), ("b", 5)]
