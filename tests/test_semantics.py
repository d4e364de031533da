"""The engine's rules where they differ from Spark's."""

import decimal

from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import aggregates as A
from lodestone.operators import joins as J


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_null_aware_membership(spark):
    left = spark.createDataFrame([(1,), (7,), (None,)], "a int")
    cases = {((None,), (7,)): {1: None, 7: True, None: None}, ((7,),): {1: False, 7: True, None: None}, (): {1: False, 7: False, None: False}}
    for rows, want in cases.items():
        right = spark.createDataFrame(list(rows), "b int")
        got = {r["a"]: r["matched"] for r in J.null_aware_flag_join(left, right, "a", "b").collect()}
        assert got == want
        kept = {r["a"] for r in J.null_aware_anti_join(left, right, "a", "b").collect()}
        assert kept == {a for a, m in want.items() if m is False}


def test_null_rules(spark):
    null = F.lit(None).cast("int")
    assert one(spark, S.greatest(F.lit(1), null), S.least(F.lit(1), null), S.divide(F.lit(1), F.lit(0)), S.sqrt(F.lit(-1.0)), S.log_positive(F.lit(0.0))) == (None,) * 5
    assert one(spark, S.int_div(F.lit(7), F.lit(0)), S.int_div_or_zero(F.lit(7), F.lit(0)), S.elt(F.lit(9), F.lit("a"))) == (None, 0, None)


def test_text_rules(spark):
    s = F.lit("abc")
    assert one(spark, S.substring(s, F.lit(0)), S.substring(s, F.lit(-4), F.lit(3)), S.substring(s, F.lit(-2)), S.substring(s, F.lit(9)), S.substring(s, F.lit(1), F.lit(0))) == ("", "", "bc", "", "")
    assert one(spark, S.pad(s, F.lit(-1), F.lit("x"), True), S.pad(s, F.lit(9), F.lit(""), True), S.pad(s, F.lit(2), F.lit(""), True), S.pad(s, F.lit(5), F.lit("xy"), False)) == (None, None, "ab", "abcxy")
    assert one(spark, S.trim_text(F.lit("xyxyaxy"), "xy"), S.text_to_int(F.lit("2006-01")), S.text_to_int(F.lit("x"))) == ("a", 2006, 0)


def test_numbers(spark):
    assert one(spark, S.shift_left(F.lit(1), F.lit(64)), S.shift_right(F.lit(-1), F.lit(63)), S.gcd(F.lit(12), F.lit(18)), S.lcm(F.lit(4), F.lit(6))) == (0, 1, 6, 12)
    assert one(spark, S.unsigned(F.bitwise_not(F.lit(0).cast("long"))))[0] == decimal.Decimal(2**64 - 1)
    assert one(spark, S.truncate(F.lit(-1.29), 1), S.truncate(F.lit(129.0), -1), S.round_age(F.lit(30)), S.round_duration(F.lit(70))) == (-1.2, 120.0, 25, 60)


def test_empty_aggregates(spark):
    none = spark.range(0)
    assert tuple(none.agg(A.bit_or(F.col("id")), A.bit_and(F.col("id")), A.uniq_up_to(F.col("id"), 3)).first()) == (0, decimal.Decimal(2**64 - 1), 0)


def test_dates(spark):
    t = F.lit("2024-02-29 13:14:15").cast("timestamp_ntz")
    assert one(spark, S.to_days(t), S.date_format(t, "%d.%m.%Y at %H"), S.str_to_date(F.lit("nonsense"), "%Y")) == (739310, "29.02.2024 at 13", None)
