"""One run of an evaluation: items of some tasks are asked about, parsed, scored and recorded."""

from __future__ import annotations

import argparse
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import shuffle_key
from plumbline.functions.parsing import probability
from plumbline.operators import metrics as m
from plumbline.operators.relational import ranked, upsert
from plumbline.operators.sampling import bootstrap_auroc, interval
from plumbline.operators.solver import Providers, TaskSpec, solve, task_table
from plumbline.sources.staging import staged


def asked(items: DataFrame, tasks: list[TaskSpec], n: int, seed: int) -> DataFrame:
    """The items of these tasks that a run asks about: of each task and condition at most n // 2 of either class, in hash
    order, with prompt, and the label turned round where the task says that it opposes."""
    known = F.broadcast(task_table(items.sparkSession, tasks).select("task", "prompt", "orient", "web", "ceiling"))
    rows = items.where("label is not null").withColumn("condition", F.coalesce("condition", F.lit("matched"))).join(known, "task")
    drawn = ranked(rows.withColumn("_h", shuffle_key(seed, F.col("id"))), ["task", "condition", "label"], ["_h", "id"], "_rn").where(F.col("_rn") <= n // 2)
    turned = F.when(F.col("orient") == "oppose", 1 - F.col("label")).otherwise(F.col("label"))
    return drawn.drop("_rn", "_h").withColumns({"label": turned, "prompt": F.replace("prompt", F.lit("{rep}"), F.col("representation").cast("string"))})


def scored(answers: DataFrame, reps: int = 200, seed: int = 0) -> DataFrame:
    """A row for each task: n, auroc and its bootstrap interval auroc_lo to auroc_hi, ece, aurc, sel_acc_50 (accuracy on the
    surer half), orient, web, of_ceiling, gap to the ceiling, and memo_delta, by how much AUROC is higher on matched items
    than on the others.  answers: id, task, condition, label, prob, orient, web, ceiling.  Intervals and risks are of the
    items with a probability."""
    about = answers.select("task", "orient", "web", "ceiling").distinct()
    matched = answers.where("condition = 'matched'")
    other = m.auroc(answers.where("condition <> 'matched'"), ["task"], name="_other")
    row = matched.groupBy("task").agg(F.count("*").alias("n")).join(m.auroc(matched, ["task"]), "task").join(m.ece_probability(matched, ["task"], name="ece"), "task")
    known = staged(matched.where("prob is not null").select("task", "id", "label", "prob"), "known")
    sure, right = F.abs(2 * F.col("prob") - 1), ((F.col("prob") > 0.5).cast("int") == F.col("label")).cast("int")
    parts = [
        interval(bootstrap_auroc(known, ["task"], reps, seed), ["task"], "auroc").withColumnsRenamed({"lo": "auroc_lo", "hi": "auroc_hi"}),
        m.aurc(known, ["task"], sure, 1 - right),
        m.selective_accuracy(known, ["task"], sure, right, name="sel_acc_50"),
    ]
    for part in parts:
        row = row.join(part, "task", "left")
    row = row.join(about, "task").join(other, "task", "left").withColumn("memo_delta", F.col("auroc") - F.col("_other"))
    return row.withColumns({"of_ceiling": F.try_divide("auroc", "ceiling"), "gap": F.col("ceiling") - F.col("auroc")}).drop("_other", "ceiling")


def stamp(model: str, seed: int, n: int) -> dict[str, str]:
    """What a run was: model, seed, size, time in UTC, and the commit of the code, if it is in a repository."""
    found = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, check=False)
    return {"model": model, "seed": str(seed), "n_per_task": str(n), "date_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%MZ"), "commit": found.stdout.strip() or "none"}


def evaluate(items: DataFrame, tasks: list[TaskSpec], model: str = "dry", n: int = 100, seed: int = 0, providers: Providers | None = None, folder: str | None = None, **options) -> DataFrame:
    """The scorecard of a run: model, task and what ``scored`` gives.

    items: id, task, representation, label, condition.  providers: who answers; by default an offline one.  options go to
    ``solve``.  folder: where the scorecard is merged with that of earlier runs, tasks of this one replacing theirs, and
    raw answers and the run's stamp are kept.
    """
    spark = items.sparkSession
    answers = staged(solve(asked(items, tasks, n, seed), model, providers, **options).withColumn("prob", probability(F.col("answer"))), "answers")
    card = scored(answers, seed=seed).withColumn("model", F.lit(model))
    if folder is None:
        return card
    now = stamp(model, seed, n)
    run = f"{folder}/run={now['date_utc'].replace(':', '')}-{seed}"
    answers.select("model", "task", "id", "condition", "label", "prob", "answer", "status").write.mode("overwrite").parquet(f"{run}/raw")
    spark.createDataFrame([tuple(now.values())], ", ".join(f"{k} string" for k in now)).coalesce(1).write.mode("overwrite").json(f"{run}/manifest")
    try:
        card = upsert(spark.read.schema(card.schema).parquet(f"{folder}/scorecard"), card, ["model", "task"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    staged(card, "scorecard").write.mode("overwrite").parquet(f"{folder}/scorecard")
    return spark.read.schema(card.schema).parquet(f"{folder}/scorecard")


def main(given: list[str] | None = None) -> None:
    """``python -m plumbline.evaluate items.jsonl --tasks a,b --out folder``: a run over a file of JSON lines."""
    from plumbline.sources.readers import jsonl_items

    ask = argparse.ArgumentParser(description=main.__doc__)
    ask.add_argument("items")
    ask.add_argument("--tasks", required=True, help="properties of the items, joined by commas")
    ask.add_argument("--model", default="dry")
    ask.add_argument("--n", type=int, default=100)
    ask.add_argument("--seed", type=int, default=0)
    ask.add_argument("--out")
    args = ask.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    items = jsonl_items(spark, args.items).withColumn("task", F.col("property"))
    tasks = [TaskSpec(t.strip(), prompt="{rep}") for t in args.tasks.split(",")]
    evaluate(items, tasks, args.model, args.n, args.seed, folder=args.out).show(truncate=False)


if __name__ == "__main__":
    main()
