"""Lookup tables with keys that aren't plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def network(ip: Column, length: Column) -> Column:
    """The first length bits of an IPv4 address given as a number."""
    rest = (32 - length).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", ip.cast("long"), rest), rest)


def longest_prefix(df: DataFrame, ip: str, prefixes: DataFrame, value: str, name: str) -> DataFrame:
    """df with the value of the longest prefix (columns network long, length int) that holds the address, NULL where none
    does. An address is looked up once for each length that occurs, of which there are 33 at most: an equality
    join on (length, network), and no range join. Of equal prefixes the smallest value counts."""
    lengths = [r[0] for r in prefixes.select("length").where("length between 0 and 32").distinct().collect()]
    table = prefixes.groupBy(F.col("length").alias("_length"), network(F.col("network"), F.col("length")).alias("_network")).agg(F.min(value).alias("_value"))
    addresses = df.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct()
    tried = addresses.withColumn("_length", F.explode(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"))).withColumn("_network", network(F.col("_ip"), F.col("_length")))
    found = tried.join(table, ["_length", "_network"]).groupBy("_ip").agg(F.max_by("_value", "_length").alias(name))
    return df.join(found, df[ip] == found["_ip"], "left").drop("_ip")
