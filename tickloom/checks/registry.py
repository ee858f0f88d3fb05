"""Registered queries: a Spark callable and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.checks.streams import Tables, with_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "", doubles: str = "", digits: int = 6):
    """Register ``fn(tables)`` under ``name``.

    ``uses`` names the derived streams the SQL reads; ``doubles`` the columns both sides round.
    """
    cols = doubles.split()
    # far below the last kept digit: exact halves then round the same way in both engines
    nudge = 0.0314159 * 10 ** -digits

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(F.col(c) + F.lit(float(f"{nudge:e}")), digits) + F.lit(0.0) for c in cols}) if cols else out
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = with_streams(uses, sql)
            if cols:
                fixed = ", ".join(f"round(CAST({c} AS DOUBLE) + {nudge:e}, {digits}) + 0.0 AS {c}" for c in cols)
                body = f"SELECT * REPLACE ({fixed}) FROM (\n{body}\n) AS q"
            SQL[name] = body
        return fn
    return wrap
