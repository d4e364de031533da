"""Ingestion of a change log: batches are appended to a delta layer, readers take the newest version of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.shapes import newest_version


def ingest(changes: DataFrame, path: str, key: str, version: str, checkpoint: str) -> None:
    """Appends all that the stream holds now. A batch is a folder of its own, replaced if it is run again, so that each change is
    there once; of a key only its newest version in the batch is kept, as late rows are settled by version and not by time."""

    def append(batch: DataFrame, number: int) -> None:
        newest_version(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot(layers: DataFrame, key: str, version: str, deleted: Column | None = None, at_most: Column | None = None) -> DataFrame:
    """What a reader sees: the newest version of each key, unless it is a deletion."""
    return newest_version(layers, key, version, at_most, deleted)


def compact(layers: DataFrame, path: str, key: str, version: str) -> None:
    """Rewrites the layers as one in which every key occurs once; deletions stay, as later layers may be older."""
    newest_version(layers, key, version).write.mode("overwrite").parquet(f"{path}/batch={-1}")


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows by tumbling window, for streams with a watermark and for tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
