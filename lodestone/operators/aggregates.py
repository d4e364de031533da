"""Aggregates and aggregate shapes that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.scalars import unsigned


def with_totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """The groups and a row of totals, whose keys are NULL."""
    columns = [c.alias(n) for n, c in aggregates.items()]
    totals = df.agg(*columns)
    return df.groupBy(*keys).agg(*columns).unionByName(totals.select(*(F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys), *aggregates))


def bit_or(c: Column) -> Column:
    """Unsigned; 0 on no input."""
    return F.coalesce(unsigned(F.bit_or(c)), F.lit(0).cast("decimal(20,0)"))


def bit_xor(c: Column) -> Column:
    """Unsigned; 0 on no input."""
    return F.coalesce(unsigned(F.bit_xor(c)), F.lit(0).cast("decimal(20,0)"))


def bit_and(c: Column) -> Column:
    """Unsigned; all ones on no input."""
    return F.coalesce(unsigned(F.bit_and(c)), F.lit("18446744073709551615").cast("decimal(20,0)"))


def uniq(c: Column) -> Column:
    """Distinct values from the 65,536 smallest of their hashes: exact up to so many, beyond them with a standard error of 0.4 percent."""
    return F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(c, 16)), F.lit(0).cast("long"))


def uniq_up_to(c: Column, n: int) -> Column:
    return F.least(F.count_distinct(c), F.lit(n + 1).cast("long"))


def group_concat(value: Column, separator: str, max_length: int | None = None, order: Column | None = None, distinct: bool = False) -> Column:
    """Values joined in ascending order of `order`, or of themselves; NULLs are left out, and a group of NULLs alone gives NULL.

    distinct values are ordered by themselves. max_length cuts the result to as many characters."""
    if distinct:
        values = F.array_sort(F.collect_set(value))
    elif order is None:
        values = F.array_sort(F.collect_list(value))
    else:
        values = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])
    out = F.when(F.count(value) > 0, F.array_join(values, separator))
    return F.left(out, F.lit(max_length)) if max_length else out


def extreme_count(df: DataFrame, keys: list[str], value: str, greatest: bool) -> DataFrame:
    """How many rows of a group have its extreme value: one aggregation by value, one by key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    pick = F.max_by if greatest else F.min_by
    return counts.groupBy(*keys).agg(pick("n", value).alias("n"))


def sum_map(df: DataFrame, keys: list[str], key_array: str, value_array: str) -> DataFrame:
    """Sums of the values of parallel arrays by their keys."""
    pairs = df.select(*keys, F.explode(F.arrays_zip(F.col(key_array).alias("k"), F.col(value_array).alias("v"))).alias("p"))
    return pairs.groupBy(*keys, F.col("p.k").alias("k")).agg(F.sum("p.v").alias("total"))


def max_intersections(df: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """The most intervals [start, end) that overlap in one place, and the first such place."""
    edges = df.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(df.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    depth = F.sum("d").over(W.partitionBy(*keys).orderBy("at"))
    return steps.withColumn("depth", depth).groupBy(*keys).agg(F.max("depth").alias("depth"), F.expr("min_by(at, struct(-depth, at))").alias("at"))


def quantile_exact(df: DataFrame, keys: list[str], value: str, levels: list[float], weight: str | None = None) -> DataFrame:
    """For each level one column q0, q1, ...: of n values in order that at place floor(level * n), the last at most; with
    weights the first value up to which the weights reach ceil(level * their sum). No interpolation.

    A group is never gathered in one row: equal values are counted first, and a running sum over the counts finds the place."""
    amount = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("_n"))
    # The values' own order inside a key; the total beside it, so that one window serves all levels.
    ordered, whole = W.partitionBy(*keys).orderBy(value), W.partitionBy(*keys)
    sums = counts.withColumn("_upto", F.sum("_n").over(ordered)).withColumn("_all", F.sum("_n").over(whole))
    reached = lambda q: F.col("_upto") >= F.ceil(F.lit(q) * F.col("_all")) if weight else F.col("_upto") > F.least(F.floor(F.lit(q) * F.col("_all")), F.col("_all") - 1)
    return sums.groupBy(*keys).agg(*(F.min(F.when(reached(q), F.col(value))).alias(f"q{i}") for i, q in enumerate(levels)))


def sequence_match(df: DataFrame, keys: list[str], order: str, event: str, codes: dict[str, str], pattern: str) -> DataFrame:
    """Whether, and how often, a regular expression over one-letter event codes matches a key's events in order."""
    code = F.coalesce(*(F.when(F.col(event) == e, c) for e, c in codes.items()), F.lit("."))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, code.alias("c")))), lambda x: x["c"]), "")
    return df.groupBy(*keys).agg(text.alias("_t")).select(*keys, F.col("_t").rlike(pattern).alias("matched"), F.regexp_count("_t", F.lit(pattern)).cast("long").alias("n"))


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, exactly; ties to the smaller value."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)
