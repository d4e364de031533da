"""Further queries of joins, aggregates, nearest vectors and extension points, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import extensions as E
from lodestone.functions import scalars as S
from lodestone.operators import aggregates as A
from lodestone.operators import joins as J
from lodestone.operators import shapes
from lodestone.session import table as T

#: Approximate aggregates: the column, and the share by which they may miss the exact value.
_COUNTS = {
    "uniq": lambda: A.uniq(F.col("l_partkey")),
    "uniq_hll12": lambda: F.approx_count_distinct("l_partkey", 0.016),
    "uniq_combined": lambda: F.approx_count_distinct("l_partkey", 0.01),
    "uniq_raw_res": lambda: F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")),
}
_QUANTILES = {
    "quantile": (0.5, 10_000),
    "median": (0.5, 10_000),
    "quantile_deterministic": (0.9, 100_000),
    "median_deterministic": (0.5, 100_000),
    "quantile_timing": (0.9, 10_000),
    "median_timing": (0.5, 10_000),
    "quantile_tdigest": (0.99, 10_000),
    "median_tdigest": (0.5, 10_000),
}
_STABLE = {
    "var_pop": lambda: F.var_pop("l_quantity"),
    "stddev_samp": lambda: F.stddev_samp("l_quantity"),
    "stddev_pop": lambda: F.stddev_pop("l_quantity"),
    "covar_samp": lambda: F.covar_samp("l_quantity", "l_discount"),
    "covar_pop": lambda: F.covar_pop("l_quantity", "l_discount"),
    "corr": lambda: F.corr("l_quantity", "l_discount"),
}


def _by_flag(column: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: T(s, d, "lineitem").groupBy("l_returnflag").agg(column().alias("v"))


def _within(approximate: Callable[[], Column], exact: Callable[[], Column], share: float) -> Callable[[], Column]:
    return lambda: F.abs(approximate() - exact()) <= exact() * share


def _count_within(approximate: Callable[[], Column], share: float) -> Callable[[SparkSession, str], DataFrame]:
    """Both counts are made apart and meet by flag: beside a distinct count Spark keeps a sketch for every distinct value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        near = _by_flag(approximate)(spark, d).select("l_returnflag", F.col("v").alias("near"), F.lit(None).cast("long").alias("exact"))
        exact = _by_flag(lambda: F.count_distinct("l_partkey"))(spark, d).select("l_returnflag", F.lit(None).cast("long").alias("near"), F.col("v").alias("exact"))
        both = near.unionByName(exact).groupBy("l_returnflag").agg(F.max("near").alias("near"), F.max("exact").alias("exact"))
        return both.select("l_returnflag", (F.abs(F.col("near") - F.col("exact")) <= F.col("exact") * share).alias("v"))

    return run


def _quantile(levels: list[float], weight: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: A.quantile_exact(T(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", levels, weight)


_PLAIN = "list_sort(list(l_extendedprice))[least(cast(floor({q} * count(*)) as bigint), count(*) - 1) + 1] as q{i}"
_WEIGHTED = """with c as (select l_returnflag, l_extendedprice as x, sum(sum(l_linenumber)) over (partition by l_returnflag order by l_extendedprice) as upto,
    sum(sum(l_linenumber)) over (partition by l_returnflag) as n from lineitem group by l_returnflag, l_extendedprice)
    select l_returnflag, {columns} from c group by l_returnflag"""


def _nearest(metric: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        asked = F.array(*(F.lit(float(i % 7 - 3) / 10) for i in range(64)))
        return shapes.nearest(T(spark, d, "embeddings"), metric(F.col("embedding"), asked), "vec_id", 10).select("vec_id", F.round("distance", 6).alias("distance"))

    return run


_DOT = "list_sum(list_transform(range(64), lambda i: cast(embedding[i + 1] as double) * ((i % 7 - 3) / 10.0)))"
_OWN = "sqrt(list_sum(list_transform(range(64), lambda i: cast(embedding[i + 1] as double) ** 2)))"
_ASKED = "sqrt(list_sum(list_transform(range(64), lambda i: ((i % 7 - 3) / 10.0) ** 2)))"
_NEAREST = "select vec_id, round(d, 6) as distance from (select vec_id, {0} as d from embeddings) order by d, vec_id limit 10"


def _user_scalar(spark: SparkSession, d: str) -> DataFrame:
    E.add_scalar(spark, "lodestone_vowels", "long", lambda x: x.str.count("[AEIOU]"))
    T(spark, d, "customer").createOrReplaceTempView("lodestone_customer")
    return spark.sql("select c_custkey as k, lodestone_vowels(c_mktsegment) as v from lodestone_customer")


def _user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    E.add_aggregate(spark, "lodestone_span", "double", lambda x: float(x.max() - x.min()))
    T(spark, d, "customer").createOrReplaceTempView("lodestone_customer")
    return spark.sql("select c_nationkey as k, round(lodestone_span(c_acctbal), 6) as v from lodestone_customer group by c_nationkey")


def _user_table(spark: SparkSession, d: str) -> DataFrame:
    E.add_table_function(spark, "lodestone_countdown", "n int", lambda x: ((i,) for i in range(x % 4, 0, -1)))
    T(spark, d, "customer").createOrReplaceTempView("lodestone_customer")
    return spark.sql("select c_custkey as k, n from lodestone_customer, lateral lodestone_countdown(c_nationkey)")


def define(register: Callable[..., None]) -> None:
    for name, column in _COUNTS.items():
        register(f"agg_{name}_within", _count_within(column, 0.1), "select l_returnflag, true as v from lineitem group by l_returnflag")
    for name, (q, accuracy) in _QUANTILES.items():
        near = lambda q=q, accuracy=accuracy: F.percentile_approx("l_extendedprice", q, accuracy)
        exact = lambda q=q: F.percentile("l_extendedprice", q)
        register(f"agg_{name}_within", _by_flag(_within(near, exact, 0.02)), "select l_returnflag, true as v from lineitem group by l_returnflag")
    for name, column in _STABLE.items():
        y = ", l_discount" if name in ("covar_samp", "covar_pop", "corr") else ""
        register(f"agg_{name}_stable", _by_flag(lambda column=column: F.round(column(), 6)), f"select l_returnflag, round({name}(l_quantity{y}), 6) as v from lineitem group by l_returnflag")

    for name, levels in {"quantile_exact": [0.25], "median_exact": [0.5], "quantiles_exact": [0.0, 0.1, 0.9, 1.0]}.items():
        columns = ", ".join(_PLAIN.format(q=q, i=i) for i, q in enumerate(levels))
        register(f"agg_{name}", _quantile(levels), f"select l_returnflag, {columns} from lineitem group by l_returnflag")
    for name, levels in {"quantile_exact_weighted": [0.25], "median_exact_weighted": [0.5], "quantiles_exact_weighted": [0.0, 0.1, 0.9, 1.0]}.items():
        columns = ", ".join(f"min(x) filter (upto >= ceil({q} * n)) as q{i}" for i, q in enumerate(levels))
        register(f"agg_{name}", _quantile(levels, "l_linenumber"), _WEIGHTED.format(columns=columns))

    register(
        "agg_group_concat_order_by",
        lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(A.group_concat(F.col("o_orderpriority"), ";", order=F.struct(F.col("o_totalprice"), F.col("o_orderkey"))).alias("v")),
        "select o_custkey, string_agg(o_orderpriority, ';' order by o_totalprice, o_orderkey) as v from orders group by o_custkey",
    )
    register(
        "agg_group_concat_distinct",
        lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(A.group_concat(F.col("o_orderpriority"), ",", distinct=True).alias("v")),
        "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as v from orders group by o_custkey",
    )
    register(
        "agg_group_concat_max_length",
        lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(A.group_concat(F.col("o_orderpriority"), ",", max_length=20).alias("v")),
        "select o_custkey, left(string_agg(o_orderpriority, ',' order by o_orderpriority), 20) as v from orders group by o_custkey",
    )
    for name, sql in {"or": "bit_or", "xor": "bit_xor"}.items():
        register(
            f"agg_bit_{name}_unsigned",
            lambda s, d, f=getattr(A, sql): T(s, d, "customer").groupBy("c_nationkey").agg(f(-F.col("c_custkey")).cast("string").alias("v")),
            f"select c_nationkey, cast((18446744073709551616::hugeint + {sql}(-c_custkey)) % 18446744073709551616::hugeint as varchar) as v from customer group by c_nationkey",
        )

    first = "select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey"
    for name, how in {"join_any_left": "left", "join_any_inner": "inner"}.items():
        register(
            name,
            lambda s, d, how=how: J.any_join(T(s, d, "customer"), T(s, d, "orders"), "c_custkey", "o_custkey", F.col("o_orderkey"), how).select("c_custkey", "o_orderkey"),
            f"select c_custkey, o_orderkey from customer {how} join ({first}) on o_custkey = c_custkey",
        )

    register("scan_ann_cosine", _nearest(S.cosine_distance), _NEAREST.format(f"1 - {_DOT} / ({_OWN} * {_ASKED})"))
    register("scan_ann_inner_product", _nearest(lambda a, b: -S.inner_product(a, b)), _NEAREST.format(f"-{_DOT}"))

    register("user_scalar_function", _user_scalar, "select c_custkey as k, cast(length(regexp_replace(c_mktsegment, '[^AEIOU]', '', 'g')) as bigint) as v from customer")
    register("user_aggregate_function", _user_aggregate, "select c_nationkey as k, round(max(c_acctbal) - min(c_acctbal), 6) as v from customer group by c_nationkey")
    register("user_table_function", _user_table, "select c_custkey as k, cast(unnest(range(1, c_nationkey % 4 + 1)) as int) as n from customer")
