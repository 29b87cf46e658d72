"""Tables in SQLite files: a folder of them is one database, dealt by a key, which tasks read by ranges of it.

Conditions go to the database when it is read, as an argument and not as a filter on the frame: Spark 4.1 keeps a filter
that was pushed to a source in Python, so a frame that is read again without it would lack rows.  A database file has one
writer, so a table is written as many files, one for each range of a hash of the key; rows that join
on it are in one file, so a join on it is the database's work.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL"}
_SIGNS = ("=", "<>", "<", "<=", ">", ">=", "in")
Condition = tuple[str, str, object]  # column, sign, value, or values for ``in``


def local_path(folder: str) -> str:
    """The folder as tasks open it; it must be on a file system that all of them mount."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"database files need a mounted folder, not {folder}")
    return folder.removeprefix("file://").removeprefix("file:")


ROWS_A_FILE = 1_000_000


def files_for(*tables: DataFrame, least: int = 8) -> int:
    """So many files that one has ROWS_A_FILE rows of these tables, since each is written by one task."""
    return max(least, -(-sum(df.count() for df in tables) // ROWS_A_FILE))


def write_databases(tables: dict[str, DataFrame], keys: dict[str, str], folder: str, files: int) -> None:
    """Writes these tables into ``files`` database files, each row into that of its key's hash; an index on the key is made.

    A task writes its file beside its temporary ones and moves it into place whole, so a task that runs twice leaves one.
    """
    at = local_path(folder)
    os.makedirs(at, exist_ok=True)
    names = list(tables)
    shapes = {n: [(f.name, _TYPES[f.dataType.simpleString()]) for f in df.schema] for n, df in tables.items()}
    rows = None
    for n, df in tables.items():
        part = df.select(F.pmod(F.xxhash64(F.col(keys[n]).cast("string")), F.lit(files)).cast("int").alias("file"), F.lit(n).alias("name"), F.to_json(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("row"))
        rows = part if rows is None else rows.unionByName(part)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[str, sqlite3.Connection]] = {}
        for batch in batches:
            for file, part in batch.groupby("file"):
                if file not in held:
                    made = os.path.join(tempfile.mkdtemp(dir=at, prefix="."), "db")
                    held[file] = made, sqlite3.connect(made)
                    for n in names:
                        held[file][1].execute(f'CREATE TABLE "{n}" ({", ".join(f"\"{c}\" {kind}" for c, kind in shapes[n])})')
                for n, own in part.groupby("name"):
                    held[file][1].executemany(f'INSERT INTO "{n}" VALUES ({", ".join("?" * len(shapes[n]))})', map(json.loads, own["row"]))
        for file, (made, connection) in held.items():
            for n in names:
                connection.execute(f'CREATE INDEX "{n}_key" ON "{n}" ("{keys[n]}")')
            connection.commit()
            connection.close()
            os.replace(made, os.path.join(at, f"{file:05}.db"))
            shutil.rmtree(os.path.dirname(made), ignore_errors=True)
            yield pd.DataFrame({"file": [file]})

    rows.repartition(files, "file").mapInPandas(write, "file int").count()


class Range(InputPartition):
    def __init__(self, file: str, low: int | None, high: int | None):
        self.file, self.low, self.high = file, low, high


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = options, [f.name for f in schema]
        self.where: list[tuple[str, list]] = []
        for name, sign, value in json.loads(options.get("where", "[]")):
            if name not in self.columns or sign not in _SIGNS:
                raise ValueError(f"no condition: {name} {sign}")
            self.where.append((f'"{name}" IN ({", ".join("?" * len(value))})', value) if sign == "in" else (f'"{name}" {sign} ?', [value]))

    def partitions(self) -> list[InputPartition]:
        """Ranges of the key within each file, from one aggregate of its smallest, its largest and the number of rows."""
        at, key = local_path(self.options["folder"]), self.options["key"]
        each, out = int(self.options.get("rowsapart", self.options.get("rowsApart", 100_000))), []
        for name in sorted(n for n in os.listdir(at) if n.endswith(".db")):
            file = os.path.join(at, name)
            if not each:
                out.append(Range(file, None, None))
                continue
            connection = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
            low, high, n = connection.execute(f'SELECT min("{key}"), max("{key}"), count(*) FROM ({self.options["query"]})').fetchone()
            connection.close()
            parts = max(1, min(-(-n // each), (high - low + 1) if n and low is not None else 1))
            if parts == 1:
                out.append(Range(file, None, None))
                continue
            step = -(-(high - low + 1) // parts)
            # the first range has rows without a key too
            out += [Range(file, None if k == 0 else low + k * step, None if k == parts - 1 else low + (k + 1) * step) for k in range(parts)]
        return out

    def statement(self, part: Range) -> tuple[str, list]:
        key, terms, values = self.options["key"], [], []
        for text, given in self.where:
            terms.append(text)
            values += given
        if part.low is not None:
            terms.append(f'"{key}" >= ?')
            values.append(part.low)
        if part.high is not None:
            terms.append(f'"{key}" < ?' if part.low is not None else f'("{key}" < ? OR "{key}" IS NULL)')
            values.append(part.high)
        columns = ", ".join(f'"{c}"' for c in self.columns)
        return f"SELECT {columns} FROM ({self.options['query']})" + (f" WHERE {' AND '.join(terms)}" if terms else ""), values

    def read(self, partition: Range) -> Iterator[tuple]:
        connection = sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)
        try:
            yield from connection.execute(*self.statement(partition))
        finally:
            connection.close()


class DatabaseSource(DataSource):
    """Rows of a query that each file of a folder answers on its own.

    Options: folder; query, which may join tables of a file; key, a whole-number column of its result that tasks share out
    by ranges; rowsApart, the rows of a task, or 0 for a task a file, which are then only read by tasks; where, a JSON list of conditions on the result.  The schema is given by the
    reader.
    """

    @classmethod
    def name(cls) -> str:
        return "databases"

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(dict(self.options), schema)


def database_rows(spark: SparkSession, folder: str, query: str, key: str, schema: str, where: list[Condition] | None = None, rows_apart: int = 100_000) -> DataFrame:
    """The rows of ``query`` over all database files of a folder that meet all conditions; the files look for them."""
    spark.dataSource.register(DatabaseSource)
    options = {"folder": folder, "query": query, "key": key, "rowsApart": rows_apart, "where": json.dumps(where or [])}
    return spark.read.format("databases").schema(schema).options(**options).load()
