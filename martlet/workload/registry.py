"""Registry of the queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.workload.views import VIEWS, table, view, with_views

_QUERIES: dict[str, tuple[Callable, str | None]] = {}
_MODULES = ("statistics", "market", "cleaning", "recommending", "learning", "streams", "runs")


class Tables:
    """The inputs of a query, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return (view if name in VIEWS else table)(self.spark, self.sf_dir, name)


def query(sql: str | None = None, doubles: str = "", digits: int = 4):
    """Register a function of ``Tables`` under its name.

    Doubles are rounded to ``digits`` on both sides: the engines add in different
    orders.  ``doubles`` names those columns for the oracle SQL.
    """
    def register(fn):
        if fn.__name__ in _QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)), digits)

        oracle = None
        if sql is not None:
            oracle = with_views(sql)
            if doubles:
                fixed = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
                oracle = f"SELECT * REPLACE ({fixed}) FROM (\n{oracle}\n) AS answer"
        _QUERIES[fn.__name__] = (run, oracle)
        return fn
    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to a number of digits, without negative zeros."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def load() -> dict[str, tuple[Callable, str | None]]:
    for module in _MODULES:
        import_module(f"martlet.workload.{module}")
    return _QUERIES
