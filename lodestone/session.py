"""Sessions and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the engine's semantics need: no exception where the engine's rule is NULL, and one time zone.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; projections and filters on it reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
