"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.tables import ANSWERS_SQL, ITEMS_SQL, PREDS_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FRAMES = {"preds": PREDS_SQL, "items": ITEMS_SQL, "answers": ANSWERS_SQL, "": ""}


def query(name: str, sql: str | None = None, of: str = ""):
    """Registers a function of Tables; ``sql`` is its DuckDB counterpart, which may use the frame ``of``.

    ``sql`` may begin with its own common table expressions, after a plus sign.
    """

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ctes = FRAMES[of]
            if body.startswith("+"):
                ctes, body = ", ".join(x for x in (ctes, body[1:].split("SELECTING", 1)[0].strip()) if x), body.split("SELECTING", 1)[1]
            ORACLE_SQL[name] = f"WITH {ctes} {body}" if ctes else body
        return f

    return add
