"""Queries whose results or work went wrong on tables larger than the given ones."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import aggregates as A
from lodestone.plans import registry


def items(spark, path, rows):
    """A lineitem table of so many parts, all returned."""
    spark.range(rows).select(F.lit("R").alias("l_returnflag"), F.col("id").alias("l_partkey")).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_uniq_of_many(spark, tmp_path):
    assert registry.queries()["agg_uniq_within"](spark, items(spark, tmp_path, 1_200_000)).first()["v"] is True


def test_uniq_of_few(spark):
    x = spark.range(60_000).select((F.col("id") % 30_000).alias("x"), F.lit(None).cast("long").alias("none"))
    assert tuple(x.agg(A.uniq(F.col("x")), A.uniq(F.col("none"))).first()) == (30_000, 0)
    assert x.limit(0).agg(A.uniq(F.col("x"))).first()[0] == 0


def test_ipv4_beyond_32_bits(spark, tmp_path):
    keys = [0, 1, 61_356, 61_357, 89_999, 5_399_999]
    spark.createDataFrame([(k, 0, 0.0, "") for k in keys], "c_custkey long, c_nationkey int, c_acctbal double, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["fn_tidb_ipv4_string_to_num"](spark, str(tmp_path)).collect()
    assert {r["k"]: r["v"] for r in got} == {k: k * 70_000 for k in keys}


def test_day_number_of_fractions(spark):
    times = {
        "2024-01-31 00:00:00": 19753, "2024-01-31 23:59:59.499999": 19753, "2024-01-31 23:59:59.5": 19754, "2024-01-31 23:59:59.999999": 19754,
        "2024-01-31 12:00:00.5": 19753, "1970-01-01 23:59:59.5": 1, "1969-12-31 23:59:59.7": 0, "1969-12-30 23:59:59.6": -1, "1969-12-30 23:59:59.4": -1,
    }
    sql = registry.oracle_sql()["fn_to_relative_day_num"]
    duck = duckdb.connect()
    duck.execute("create table events as select row_number() over () as event_id, unnest as ts from unnest(?::timestamp[])", [list(times)])
    assert [v for _, v in duck.execute(f"select * from ({sql}) order by k").fetchall()] == list(times.values())
    rows = spark.createDataFrame(list(enumerate(times)), "i int, t string").select("i", S.day_number(F.col("t").cast("timestamp_ntz")).alias("v"))
    assert [r["v"] for r in rows.orderBy("i").collect()] == list(times.values())


def test_last_half_second_of_a_day(spark, tmp_path):
    made = spark.sql("select 1L as event_id, timestamp_ntz'2024-01-31 23:59:59.5' as ts, 1L as user_id, '' as event_type, 0d as value, '{}' as props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    assert registry.queries()["fn_to_relative_day_num"](spark, str(tmp_path)).first()["v"] == 19754


def named(spark, column):
    """How often the optimized plan of a column names its input."""
    plan = spark.createDataFrame([("",)], "given string").repartition(2).select(column.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    return plan.partition("\n")[0].count("given#")


def test_addresses_are_found_once_a_row(spark):
    assert named(spark, S.inet6_ntoa(S.inet6_aton(F.col("given")))) == named(spark, S.inet6_aton(F.col("given"))) == 1
    assert named(spark, S.inet6_ntoa(F.col("given").cast("binary"))) == 1


def test_addresses_of_every_form(spark):
    rows = spark.createDataFrame(list(enumerate([None, "::", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "0:0:1:0:0:0:0:1", "::ffff:1.2.3.4", "::ffff:1.2.3.256", "1.2.3.4", "256.1.1.1", "12345::", "A:0:0:b:0:0:0:1"])), "i int, a string")
    got = [r["v"] for r in rows.orderBy("i").select(S.inet6_ntoa(S.inet6_aton(F.col("a"))).alias("v")).collect()]
    assert got == [None, "::", "1::", "1:2:3:4:5:6:7:8", None, None, "0:0:1::1", "::ffff:102:304", None, "1.2.3.4", None, None, "a:0:0:b::1"]


@pytest.mark.parametrize("name", ["uniq", "uniq_hll12", "uniq_combined", "uniq_raw_res"])
def test_no_sketch_for_each_distinct_value(spark, tmp_path, name):
    run = registry.queries()[f"agg_{name}_within"](spark, items(spark, tmp_path, 100))
    aggregates = [x for x in run._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(" in x]
    keys = [re.search(r"keys?=\[(.*?)\]", x)[1] for x in aggregates]
    sketched = [re.search("approx_count_distinct|sketch_agg", x) is not None for x in aggregates]
    assert any("l_partkey" in k for k in keys) and any(sketched)
    assert not any("l_partkey" in k and s for k, s in zip(keys, sketched, strict=True))
    assert [tuple(r) for r in run.collect()] == [("R", True)]


def test_counts_of_groups_without_key_or_values(spark, tmp_path):
    spark.createDataFrame([(None, 1), (None, 2), ("A", None)], "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("uniq", "uniq_hll12", "uniq_combined", "uniq_raw_res"):
        assert {tuple(r) for r in registry.queries()[f"agg_{name}_within"](spark, str(tmp_path)).collect()} == {(None, True), ("A", True)}


def test_erf_without_a_series(spark):
    xs = [0.0, 1e-300, -1e-9, 0.3, 0.84, 0.85, -1.2, 1.3, 2.4, 2.8, -2.9, 4.5, 5.99, 6.0, -7.0, float("inf"), float("-inf"), None]
    made = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", S.erf(F.col("x")).alias("v"))
    got = [r["v"] for r in made.orderBy("i").collect()]
    assert got == [None if x is None else pytest.approx(math.erf(x), rel=1e-15) for x in xs]
    assert made.where(F.col("i") == 1).first()["v"] > 0
    for name in ("fn_erf", "fn_erfc"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "aggregate(" not in plan and plan.count("c_nationkey#") <= 3
