"""Extension points: functions of a user's own, by name in SQL. All of them work on Arrow batches, none on single rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def add_scalar(spark: SparkSession, name: str, kind: str, f: Callable[[pd.Series], pd.Series]) -> None:
    """A scalar function over whole columns of one argument; NULLs come as pandas has them."""

    def run(x: pd.Series) -> pd.Series:
        return f(x)

    spark.udf.register(name, F.pandas_udf(run, kind))


def add_aggregate(spark: SparkSession, name: str, kind: str, f: Callable[[pd.Series], float]) -> None:
    """An aggregate of one argument. A group is one series, so it has to fit in an executor; Spark has no partial results for
    such functions: reduce the rows by built-in aggregates first where a group can be large."""

    def run(x: pd.Series) -> float:
        return f(x)

    spark.udf.register(name, F.pandas_udf(run, kind))


def add_table_function(spark: SparkSession, name: str, kind: str, rows: Callable) -> None:
    """A table function: rows(argument) yields tuples; for LATERAL and FROM."""

    class Function:
        def eval(self, x):
            yield from rows(x)

    spark.udtf.register(name, F.udtf(Function, returnType=kind, useArrow=False))
