"""Queries of formats, dictionaries and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.session import scratch, table
from lodestone.sources import dictionaries, formats
from lodestone.streaming import ingest

_CUSTOMERS = "select c_custkey, case when c_custkey % 7 = 0 then null when c_custkey % 5 = 0 then concat(c_name, chr(9), chr(92), 'n', chr(10), '''x') else c_name end as name, c_nationkey from customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("\t\\n\n'x"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), "c_nationkey")


@query("format_tab_separated", _CUSTOMERS)
def tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _customers(spark, sf_dir), scratch(spark, "tsv")
    formats.write_tab_separated(rows, path)
    return formats.read_tab_separated(spark, path, rows.schema)


@query("format_tab_separated_with_names", _CUSTOMERS)
def tab_separated_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _customers(spark, sf_dir), scratch(spark, "tsv-names")
    formats.write_tab_separated_with_names(rows, path)
    return formats.read_tab_separated_with_names(spark, path, rows.schema)


@query("format_json_each_row", _CUSTOMERS)
def json_each_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _customers(spark, sf_dir), scratch(spark, "json")
    formats.write_json_each_row(rows, path)
    return formats.read_json_each_row(spark, path, rows.schema)


@query("format_json", "select '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' as row from customer")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.json_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("format_json_compact", "select '[' || c_custkey || ',\"' || c_name || '\"]' as row from customer")
def json_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.json_compact_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("format_values", "select '(' || c_custkey || ',' || case when c_custkey % 7 = 0 then 'NULL' else '''' || c_name || '''' end || ')' as row from customer")
def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name")
    return formats.values_rows(table(spark, sf_dir, "customer").select("c_custkey", name))


@query(
    "dictionary_ip_trie",
    """with a as (select c_custkey, c_custkey * 2654435761 % 4294967296 as ip from customer),
       p as (select n_nationkey::bigint * 10 % 256 * 16777216 as network, 8 as length, n_name from nation
             union all select n_nationkey::bigint * 40 % 256 * 16777216, 5, n_name from nation where n_nationkey < 6)
       select c_custkey, (select arg_max(n_name, length) from p where ip // (1 << (32 - length)) = network // (1 << (32 - length))) as place from a""",
)
def ip_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 2654435761 % 4294967296).alias("ip"))
    nation = table(spark, sf_dir, "nation")
    wide = nation.select((F.col("n_nationkey").cast("long") * 10 % 256 * 16777216).alias("network"), F.lit(8).alias("length"), "n_name")
    wider = nation.where("n_nationkey < 6").select((F.col("n_nationkey").cast("long") * 40 % 256 * 16777216), F.lit(5), "n_name")
    return dictionaries.longest_prefix(addresses, "ip", wide.union(wider), "n_name", "place").select("c_custkey", "place")


_INGESTED = "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 and event_type <> 'error'"


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    path = scratch(spark, "delta")
    schema = table(spark, sf_dir, "events").schema
    # A stream reads folders: the table's file by its name.
    changes = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.ingest(changes, path, "user_id", "event_id", scratch(spark, "ingest"))
    return spark.read.parquet(path), path


@query("stream_ingest", _INGESTED)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.snapshot(_layers(spark, sf_dir)[0], "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "value")


@query("compact", "select user_id, max(event_id) as event_id from events group by user_id")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers, target = _layers(spark, sf_dir)[0], scratch(spark, "compacted")
    ingest.compact(layers.drop("batch"), target, "user_id", "event_id")
    return spark.read.parquet(target).select("user_id", "event_id")


@query("stream_windowed_counts", "select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(events, "ts", "event_type", "1 hour", "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
