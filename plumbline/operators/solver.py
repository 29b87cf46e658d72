"""Solvers: who answers prompts, and how often, inside Spark tasks."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (model, prompt) -> answer, or answer and why it ended: "length" if it was cut short, "refusal" if it was refused
Complete = Callable[[str, str], "str | tuple[str, str]"]


@dataclass(frozen=True)
class TaskSpec:
    """A task: where its items are and how they are asked about."""

    task: str
    kind: str = "pairs"
    data: str = ""
    prompt: str = "{rep}"
    orient: str = "align"
    web: str = "mixed"
    ceiling: float | None = None


def task_table(spark: SparkSession, tasks: list[TaskSpec]) -> DataFrame:
    return spark.createDataFrame([asdict(t) for t in tasks], "task string, kind string, data string, prompt string, orient string, web string, ceiling double")


def offline(model: str, prompt: str) -> str:
    """An answer that depends on the model's name and the prompt alone."""
    return f"Probability: 0.{int(hashlib.md5(f'{model}:{prompt}'.encode()).hexdigest()[:8], 16) % 1000:03d}"


@dataclass
class Providers:
    """Who answers for which model: the first whose predicate holds."""

    entries: list[tuple[Callable[[str], bool], Complete]] = field(default_factory=lambda: [(lambda _: True, offline)])

    def insert(self, serves: Callable[[str], bool], complete: Complete) -> None:
        """Goes before all others."""
        self.entries.insert(0, (serves, complete))

    def of(self, model: str) -> Complete:
        return next(c for serves, c in self.entries if serves(model))


def answer(complete: Complete, model: str, prompt: str, tries: int = 3, pause: float = 0.5) -> tuple[str | None, str]:
    """The answer and its status: ok, empty, refusal, truncated, or the error's name after the last try."""
    for k in range(tries):
        try:
            text = complete(model, prompt)
        except Exception as e:  # a provider may fail in any way; its name is the row's status
            if k + 1 == tries:
                return None, f"err:{type(e).__name__}"
            time.sleep(pause * 2**k)
            continue
        text, ended = text if isinstance(text, tuple) else (text, "stop")
        if ended == "refusal":
            return text, "refusal"
        if not text or not text.strip():
            return text, "empty"
        if ended == "length":
            return text, "truncated"
        refused = any(x in text.lower() for x in ("i cannot", "i can't", "unable to"))
        return text, "refusal" if refused else "ok"
    return None, "err"


def solve(prompts: DataFrame, model: str, providers: Providers | None = None, at_once: int | None = None, workers: int = 1, pause: float = 0.5) -> DataFrame:
    """prompts (with columns id and prompt) with answer and status.

    ``at_once`` bounds the tasks that ask at a time, ``workers`` the prompts that a task has out at a time.
    """
    complete = (providers or Providers()).of(model)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with ThreadPoolExecutor(workers) as pool:
                found = list(pool.map(lambda p: answer(complete, model, p, pause=pause), batch["prompt"]))
            yield batch.assign(answer=[a for a, _ in found], status=[s for _, s in found])

    dealt = prompts.repartition(at_once) if at_once else prompts
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return dealt.mapInPandas(ask, f"{schema}, answer string, status string").withColumn("model", F.lit(model))
