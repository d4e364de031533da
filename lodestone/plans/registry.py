"""Collects the queries of the engine: for each key a callable on (spark, sf_dir) and, where possible, SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(key: str, query: Query, sql: str | None = None) -> None:
    if key in _QUERIES:
        raise ValueError(f"{key} is registered already")
    _QUERIES[key] = query
    if sql:
        _ORACLE[key] = sql


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator form of register."""

    def wrap(f: Query) -> Query:
        register(key, f, sql)
        return f

    return wrap


@query(
    "agg_hash",
    """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price,
       avg(l_quantity) as avg_qty, count(*) as count_order
       from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, group and aggregate: the pricing summary."""
    from pyspark.sql import functions as F

    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("count_order")
    )


class _Anything:
    """Stands for columns where only keys and SQL are asked for, which needs no session."""

    def __getattr__(self, name):
        return self

    def __call__(self, *a, **k):
        return self

    def _same(self, *a):
        return self

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = __mod__ = __rmod__ = _same
    __and__ = __rand__ = __or__ = __ror__ = __invert__ = __neg__ = __getitem__ = _same
    __eq__ = __ne__ = __lt__ = __le__ = __gt__ = __ge__ = _same
    __hash__ = None


def _defined(real: bool) -> tuple[dict[str, Query], dict[str, str]]:
    from lodestone.plans import functions, more_functions, more_relational, relational, storage  # noqa: F401

    found, sql = dict(_QUERIES), dict(_ORACLE)

    def add(key: str, f: Query, text: str | None = None) -> None:
        if key in found:
            raise ValueError(f"{key} is registered already")
        found[key] = f
        if text:
            sql[key] = text

    x = _Anything()
    relational.define(add, **({} if real else {"F": x, "S": x, "A": x, "W": x}))
    functions.define(add, **({} if real else {"F": x, "S": x}))
    more_functions.define(add)
    more_relational.define(add)
    return found, sql


_REAL: dict[str, Query] = {}


def _run(key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not _REAL:
            _REAL.update(_defined(True)[0])
        return _REAL[key](spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {key: _run(key) for key in _defined(False)[0]}


def oracle_sql() -> dict[str, str]:
    return _defined(False)[1]
