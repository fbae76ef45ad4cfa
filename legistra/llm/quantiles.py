"""Percentiles of very large columns from mergeable logarithmic bucket counts.

A sketch is a table: keys, sign (-1, 0, 1), bucket, n. Bucket b of sign 1 holds the values in
(gamma^(b-1), gamma^b] with gamma = (1 + accuracy) / (1 - accuracy), so any value of it is within `accuracy`
of the bucket's middle, relatively. Sketches of partitions or days merge by adding counts; the number of
buckets of a group is bounded by the range of doubles (about 71,000 a sign at an accuracy of 1 %).

Null and NaN values, and infinite ones, don't take part. Values nearer to 0 than 1e-300 count as 0. An empty
table gives an empty sketch and no percentiles. Keys may be null; a null key is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.scale import running_counts, salted_join
from legistra.session import cut

TINY = 1e-300


def _gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy lies between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def with_bucket(df: DataFrame, value: str, accuracy: float) -> DataFrame:
    """df, without values that don't take part, plus sign and bucket."""
    v = F.col(value).cast("double")
    proper = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    sign = F.when(F.abs(v) < TINY, 0).otherwise(F.signum(v).cast("int"))
    log = F.log(F.greatest(F.abs(v), F.lit(TINY))) / F.lit(math.log(_gamma(accuracy)))
    return df.where(proper).withColumn("sign", sign).withColumn("bucket", F.when(sign == 0, 0).otherwise(F.ceil(log)).cast("int"))


def sketch(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """keys, sign, bucket, n."""
    return with_bucket(df.select(*keys, value), value, accuracy).groupBy(*keys, "sign", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: Sequence[DataFrame] | DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch from several of the same accuracy, or from one with finer keys."""
    if isinstance(sketches, DataFrame):
        sketches = [sketches]
    every = sketches[0].select(*keys, "sign", "bucket", "n")
    for s in sketches[1:]:
        every = every.unionByName(s.select(*keys, "sign", "bucket", "n"))
    return every.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def _ordered(sk: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("sign") * F.lit(1), F.col("sign") * F.col("bucket"))
    return sk.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys))
    )


def percentiles(sk: DataFrame, keys: Sequence[str], qs: Sequence[float], accuracy: float = 0.01, upper: bool = False) -> DataFrame:
    """keys, q, total, estimate: the value at rank floor(q * (total - 1)), within `accuracy` of it relatively.

    upper adds a row for the value at the next rank up, where q lies between two.
    """
    gamma = _gamma(accuracy)
    middle = F.col("sign") * F.lit(2.0) * F.pow(F.lit(gamma), F.col("bucket")) / F.lit(gamma + 1)
    asked = _ordered(sk, keys).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rank = F.floor(F.col("q") * (F.col("total") - 1))
    if upper:
        above = F.ceil(F.col("q") * (F.col("total") - 1))
        asked = asked.withColumn("__rank", F.explode(F.array_distinct(F.array(rank, above))))
        rank = F.col("__rank")
    hit = asked.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    return hit.select(*keys, "q", "total", middle.cast("double").alias("estimate"))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """keys, median: the exact median, the mean of the two middle values where their number is even.

    The sketch names the one or two buckets that hold the middle; only their values are sorted, over all tasks.
    """
    keys = list(keys)
    bucketed = with_bucket(df.select(*keys, value), value, accuracy)
    sk = bucketed.groupBy(*keys, "sign", "bucket").agg(F.count("*").alias("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    before = F.col("upto") - F.col("n")
    wanted = (
        _ordered(sk, keys)
        .where(((before <= low) & (low < F.col("upto"))) | ((before <= high) & (high < F.col("upto"))))
        .select(*keys, "sign", "bucket", before.alias("below"), low.alias("low"), high.alias("high"))
    )
    tags = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"__k{i}") for i, k in enumerate(keys)]
    on = [f"__k{i}" for i in range(len(keys))] + ["sign", "bucket"]
    inside = bucketed.select(*tags, "sign", "bucket", F.col(value).cast("double").alias("v"), *keys).join(
        wanted.select(*tags, "sign", "bucket", "below", "low", "high"), on, "inner"
    )
    counts = inside.groupBy(*keys, "sign", "bucket", "below", "low", "high", "v").agg(F.count("*").alias("n"))
    placed = running_counts(counts, [*keys, "sign", "bucket"], [F.col("v")], "n", "earlier")
    first = F.col("below") + F.col("earlier")
    holds = lambda r: (first <= r) & (r < first + F.col("n"))
    return placed.groupBy(*keys).agg(
        ((F.max(F.when(holds(F.col("low")), F.col("v"))) + F.max(F.when(holds(F.col("high")), F.col("v")))) / 2).alias("median")
    )


METRICS = ("elapsed_s", "total_tokens", "llm_calls")


def unique_runs(runs: DataFrame) -> DataFrame:
    """run_id, system, eval_granularity, day and the metrics of each run; of repeats that differ, the one logged first stands."""
    kept = runs.groupBy("run_id").agg(F.min(F.struct("logged_at", "started_at", "system", "eval_granularity", *METRICS)).alias("r"))
    return kept.select("run_id", "r.system", "r.eval_granularity", F.to_date("r.started_at").alias("day"), *[f"r.{m}" for m in METRICS])


def run_values(unique: DataFrame) -> DataFrame:
    """run_id, system, eval_granularity, day, metric, value: the valid values of unique runs.

    Null, NaN and negative values are left out.
    """
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    long = unique.select("run_id", "system", "eval_granularity", "day", F.inline(each))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0))


def daily_sketch(runs: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """The sketch of every system, granularity, metric and day."""
    return sketch(run_values(unique_runs(runs)), ["system", "eval_granularity", "metric", "day"], "value", accuracy)


def run_percentiles(runs: DataFrame, qs: Sequence[float] = (0.5, 0.9, 0.95, 0.99), accuracy: float = 0.01) -> DataFrame:
    """Percentiles per system, granularity and metric, merged from the days' sketches."""
    keys = ["system", "eval_granularity", "metric"]
    return percentiles(merge(daily_sketch(runs, accuracy), keys), keys, qs, accuracy)


def outlying_runs(runs: DataFrame, factor: float = 3.0, accuracy: float = 0.01) -> DataFrame:
    """run_id, metric: runs whose value is more than `factor` times the median of its system and granularity.

    The merged sketch's median decides for all values that are farther from the limit than its error; the exact median is
    only worked out for the groups that have values nearer to it. Both middle values count where their number is even.
    """
    keys = ["system", "eval_granularity", "metric"]
    values = run_values(cut(unique_runs(runs)))
    tag = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys]).alias("__group")
    sk = merge(sketch(values, [*keys, "day"], "value", accuracy), keys)
    # the middle values lie in the buckets of these two ranks; a bucket is within `accuracy` of its estimate on both sides
    middle = percentiles(sk, keys, (0.5,), accuracy, upper=True).select(tag, "q", "estimate")
    bounds = middle.groupBy("__group").agg((F.min("estimate") * (1 - accuracy)).alias("low"), (F.max("estimate") * (1 + accuracy)).alias("high"))
    tagged = values.select("run_id", *keys, "value", tag)
    # a row per group of systems, granularities and metrics; values don't move if these are few
    judged = salted_join(tagged, bounds, ["__group"], by=["run_id"]).where(F.col("value") >= factor * F.col("low") * (1 - 1e-9))
    sure = F.col("value") > factor * F.col("high") * (1 + 1e-9)
    judged = cut(judged.select("run_id", *keys, "value", "__group", sure.alias("sure")))
    doubtful = judged.where("not sure")
    asked = doubtful.select("__group").distinct()
    exact = exact_medians(tagged.join(asked, "__group", "left_semi"), keys, "value", accuracy).select(tag, "median")
    near = salted_join(doubtful, exact, ["__group"], by=["run_id"]).where(F.col("value") > factor * F.col("median"))
    return judged.where("sure").select("run_id", "metric").unionByName(near.select("run_id", "metric"))
