"""Streams: repeats left out within a watermark, windowed counts, and newest-wins upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legistra.operators.corpus_tables import newest


def without_repeats(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The stream with each key once, among rows that come within `late` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, group: str, value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """group, window_start, n, total per window; closed windows come out once."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(group, F.col("window.start").alias("window_start"), "n", "total")


def upsert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps, per batch, the newest row of each key under path/batch=n.

    Writing a batch again replaces it, so that repeats after a failure change nothing; `latest` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(batches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    return newest(batches, keys, [*order, "batch"])
