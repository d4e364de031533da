"""Joins that Spark's join types don't spell: match flags, three-valued membership, keys under coercion or collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "matched", negate: bool = False) -> DataFrame:
    """Every left row with a flag: whether its key is among the right's keys. Keys of NULL never match."""
    keys = right.select(F.col(right_key).alias("_k")).where("_k is not null").distinct().withColumn("_m", F.lit(True))
    out = left.join(keys, left[left_key] == F.col("_k"), "left")
    flag = F.coalesce("_m", F.lit(False))
    return out.withColumn(name, ~flag if negate else flag).drop("_k", "_m")


def null_aware_flag_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "matched", negate: bool = False) -> DataFrame:
    """`key IN (right keys)` with SQL's three values: NULL where neither a match nor its absence is certain.

    The right side is reduced to one row of counts (broadcast: one row) and to distinct keys for the equality join."""
    keys = right.select(F.col(right_key).alias("_k"))
    facts = F.broadcast(keys.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_k").isNull()).alias("_nulls")))
    distinct = keys.where("_k is not null").distinct().withColumn("_m", F.lit(True))
    out = left.join(distinct, left[left_key] == F.col("_k"), "left").join(facts, how="inner")
    unknown = F.lit(None).cast("boolean")
    flag = F.when(F.col("_n") == 0, False).when(F.col("_m"), True).when(left[left_key].isNull() | (F.col("_nulls") > 0), unknown).otherwise(False)
    return out.withColumn(name, ~flag if negate else flag).drop("_k", "_m", "_n", "_nulls")


def null_aware_anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """`WHERE key NOT IN (right keys)`: nothing if a right key is NULL; a NULL left key stays only if the right is empty."""
    return null_aware_flag_join(left, right, left_key, right_key, "_in").where(~F.col("_in")).drop("_in")


def condition_flag_join(left: DataFrame, right: DataFrame, condition: Column, name: str = "matched", negate: bool = False) -> DataFrame:
    """Every left row with a flag: whether any right row meets the condition, whatever it compares. Columns of the left are
    named by outer(). An unknown condition is no match. Planned as an existence join: no row is repeated."""
    flag = right.where(condition).exists()
    return left.select("*", (~flag if negate else flag).alias(name))


def any_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: Column, how: str = "left") -> DataFrame:
    """ANY join: of the right rows with a left row's key only one joins, that which comes first by order. The right side has
    one row a key before it is joined, by an aggregate with partial results."""
    first = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_k")).agg(F.min_by(F.struct("*"), order).alias("_r"))
    return left.join(first, left[left_key] == F.col("_k"), how).select(*(left[c] for c in left.columns), "_r.*")


def coerced_equal(left: Column, right: Column, kind: str) -> Column:
    """Equality of two keys under their common supertype."""
    return left.cast(kind) == right.cast(kind)


def collated_equal(left: Column, right: Column, collation: str) -> Column:
    return F.collate(left, collation) == F.collate(right, collation)


def sized_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else as it is, for Spark's own choice."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
