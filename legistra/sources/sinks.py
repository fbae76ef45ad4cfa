"""Sinks: appends, newest-wins upserts, and deletes that reach every table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legistra.operators.corpus_tables import newest

MODES = {"fail": "errorifexists", "resume": "append", "overwrite": "overwrite"}


def write_run(records: DataFrame, path: str, mode: str = "fail", by: Sequence[str] = ("system", "eval_granularity")) -> None:
    """Records as Parquet, one folder per combination. mode: fail if there, resume by appending, or overwrite."""
    records.write.mode(MODES[mode]).partitionBy(*by).parquet(path)


def union_columns(*parts: DataFrame) -> DataFrame:
    """All rows under all columns, in the order in which they are first seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in `order`, of equal ones the new."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return newest(both, keys, [*order, "__new"]).drop("__new")


def reconcile(tables: Mapping[str, DataFrame], dropped: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the dropped keys."""
    gone = dropped.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def append_once(log: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """A log with the entries whose key it doesn't have yet."""
    return log.unionByName(entries.dropDuplicates([key]).join(log.select(key), key, "left_anti"), allowMissingColumns=True)


def progress_labels(metrics: DataFrame, largest_k: int = 10) -> DataFrame:
    """query_id, label: ERR, HIT for a hit at 1, TOP for one at the largest cutoff, MISS.

    metrics: query_id, error, hit_1, hit_k.
    """
    label = F.when(F.coalesce(F.col("error") != "", F.lit(False)), "ERR").when(F.col("hit_1") > 0, "HIT").when(F.col("hit_k") > 0, "TOP").otherwise("MISS")
    return metrics.select("query_id", label.alias("label"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """What write_run wrote."""
    return spark.read.parquet(path)
