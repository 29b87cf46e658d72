"""Counts of terms from a web service: a batch source for a list of terms, and the counts of a table's terms.

Each term is asked once, by the task that has it.  Failures are tried again after growing pauses, and then are rows.  The list
is an option of the source, not a filter on it: Spark 4.1 keeps a filter that was pushed to a source in Python, so a frame
that is read again without it would lack rows.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.staging import staged

ROW = "term string, n bigint, status string"


class Asker:
    """Asks one term after the other, no faster than so many a second."""

    def __init__(self, url: str, field: str, tries: int = 3, pause: float = 1.0, rate: float = 3.0, timeout: float = 30.0):
        self.url, self.field, self.tries, self.pause, self.timeout = url, field.split("."), tries, pause, timeout
        self.each, self.next = 1 / rate if rate > 0 else 0.0, 0.0

    def once(self, term: str) -> int:
        wait = self.next - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.next = time.monotonic() + self.each
        with urllib.request.urlopen(self.url.replace("{term}", urllib.parse.quote(term, safe="")), timeout=self.timeout) as answer:
            found = json.load(answer)
        for name in self.field:
            found = found[name]
        return int(found)

    def count(self, term: str) -> tuple[int | None, str]:
        """The count and ``ok``, or none and what went wrong the last time."""
        status = "no tries"
        for k in range(self.tries):
            if k:
                time.sleep(self.pause * 2 ** (k - 1))
            try:
                return self.once(term), "ok"
            except urllib.error.HTTPError as e:
                status = f"http:{e.code}"
            except (OSError, ValueError, KeyError, TypeError) as e:
                status = f"err:{type(e).__name__}"
        return None, status


def _asker(options: dict, tasks_at_once: int) -> Asker:
    rate = float(options.get("rate", 3.0)) / max(1, tasks_at_once)
    return Asker(options["url"], options.get("field", "count"), int(options.get("tries", 3)), float(options.get("pause", 1.0)), rate, float(options.get("timeout", 30)))


class Terms(InputPartition):
    def __init__(self, terms: list[str]):
        self.terms = terms


class CountReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        terms = [t for t in dict.fromkeys(json.loads(self.options["terms"])) if t is not None]
        n = max(1, min(len(terms), int(self.options.get("partitions", 8))))
        return [Terms(terms[k::n]) for k in range(n)]

    def read(self, partition: Terms) -> Iterator[tuple]:
        asker = _asker(self.options, int(self.options.get("tasksAtOnce", 1)))
        for term in partition.terms:
            yield (term, *asker.count(term))


class CountSource(DataSource):
    """term, n, status of these terms.

    Options: terms, a JSON list; url, with {term}; field, the count's place in the JSON answer, names joined by dots; tries, pause (seconds before
    the second try, then doubled), rate (requests a second of an executor), tasksAtOnce (tasks an executor runs at once, which
    share its rate), partitions, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "counts"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> CountReader:
        return CountReader(dict(self.options))


def counts_of(spark: SparkSession, terms: list[str], **options) -> DataFrame:
    """The counts of a list of terms, with the options of CountSource."""
    spark.dataSource.register(CountSource)
    return spark.read.format("counts").options(terms=json.dumps(terms), **options).load()


def counted(terms: DataFrame, column: str, tasks: int = 8, **options) -> DataFrame:
    """term, n, status of every distinct term of a table, with the options of CountSource.

    Terms are dealt to so many tasks, and what they were told is written, so that nothing that reads it asks again.
    """
    at_once = int(options.get("tasksAtOnce", 1))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asker = _asker(options, at_once)
        for batch in batches:
            rows = [(t, *asker.count(t)) for t in batch["term"]]
            yield pd.DataFrame(rows, columns=["term", "n", "status"]).astype({"n": "Int64"})

    distinct = terms.select(F.col(column).alias("term")).where("term is not null").distinct()
    return staged(distinct.repartition(tasks, "term").mapInPandas(ask, ROW), "counts")
