"""Row shapes: versions, limits by group, groups frames, full-text scores, nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_version(df: DataFrame, key: str, version: str, at_most: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """A key's row of the greatest version not over at_most, unless that row is a deletion."""
    seen = df.where(F.col(version) <= at_most) if at_most is not None else df
    last = seen.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")
    return last.where(~deleted) if deleted is not None else last


def limit_by(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def groups_frame(df: DataFrame, value: Column, partition: list[str], order: str, before: int, after: int, name: str) -> DataFrame:
    """A frame counted in groups of peers: dense ranks, then a range over them."""
    ranked = df.withColumn("_g", F.dense_rank().over(W.partitionBy(*partition).orderBy(order)))
    return ranked.withColumn(name, value.over(W.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after))).drop("_g")


def nearest(df: DataFrame, distance: Column, key: str, k: int) -> DataFrame:
    return df.withColumn("distance", distance).where("distance is not null").orderBy("distance", key).limit(k)


def _equals(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the rows that hold a term. Word counts come from one pass without exploding a word: terms are few."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    own = docs.select(key, F.size(F.filter(words, lambda w: w != "")).alias("n"), *(F.size(F.filter(words, _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    facts = F.broadcast(own.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        return F.log((F.col("docs") - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))

    score = sum((part(i) for i in range(1, len(terms))), part(0))
    return own.join(facts, how="inner").where(sum((F.col(f"tf{i}") for i in range(1, len(terms))), F.col("tf0")) > 0).select(key, score.alias("score"))
