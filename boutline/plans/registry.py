"""Registered queries and the SQL each is checked against.

A query's column list fixes both outputs: ``name:b`` whole number, ``:d`` number rounded to
six places, ``:s`` text, ``:t`` date, ``:ts`` timestamp.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from boutline.session import ship
from boutline.sources.contests import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, cols: str, sql: str | None = None):
    spec = [c.rsplit(":", 1) for c in cols.split()]

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, folder)).select(*[_out(c, kind) for c, kind in spec])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _wrap(sql, spec)
        return build

    return register


def _out(c: str, kind: str):
    col = F.col(c)
    if kind == "b":
        return col.cast("long").alias(c)
    if kind == "d":
        # Six places; the tie sits just off the exact half so that last-bit noise cannot flip it.
        return (F.floor(col.cast("double") * F.lit(1e6) + F.lit(0.5001)) / F.lit(1e6)).alias(c)
    if kind == "t":
        return col.cast("date").alias(c)
    if kind == "ts":
        return col.cast("timestamp_ntz").alias(c)
    return col.cast("string").alias(c)


def _wrap(sql: str, spec) -> str:
    shape = {"b": "CAST({0} AS BIGINT) AS {0}", "d": "FLOOR(CAST({0} AS DOUBLE) * 1e6 + 0.5001e0) / 1e6 AS {0}",
             "t": "CAST({0} AS DATE) AS {0}", "ts": "CAST({0} AS TIMESTAMP) AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}"}
    outer = ", ".join(shape[kind].format(c) for c, kind in spec)
    return f"SELECT {outer} FROM (\n{sql.strip()}\n) AS checked"
