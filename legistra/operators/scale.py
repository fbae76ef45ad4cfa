"""Building blocks that keep hot keys and long orders out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legistra.session import cut


HOT_ROWS = 200_000  # rows of one key that a single task takes without trouble
TRACKED = 256  # a key with a larger share than one in so many is found if it is hot


def hot_keys(df: DataFrame, keys: list[str], least: int = HOT_ROWS) -> dict[int, int]:
    """The hash of every key with at least `least` rows and one in TRACKED of all rows, with its number of rows.

    One pass with a sketch of bounded size. There are never more than TRACKED such keys, whatever the data.
    """
    hashed = df.select(F.xxhash64(*keys).alias("__h"))
    row = hashed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(__h, {TRACKED}, {16 * TRACKED})").alias("top")).first()
    return {t["item"]: t["count"] for t in row.top or [] if t["count"] >= max(least, row.n / TRACKED)}


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right on `on`, where the hot keys of left are spread over as many tasks as their size asks for.

    Heat is measured, in a pass over left's keys, unless `rows`, the number of left's rows, says that no key can be hot. Only
    the rows of right that a hot key meets are repeated, once for each of its tasks; all else is a plain join.
    `by` are columns of left whose hash chooses the task. For inner, left, left_semi and left_anti.
    """
    hot = {} if rows is not None and rows < HOT_ROWS else hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    sizes = F.create_map(*[F.lit(x) for h, n in hot.items() for x in (h, -(-n // HOT_ROWS) + 1)])
    tasks = F.coalesce(F.try_element_at(sizes, F.xxhash64(*on)), F.lit(1))
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*by), tasks).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def running_counts(df: DataFrame, keys: list[str], order: list[Column], weight: str, before: str, partitions: int | None = None) -> DataFrame:
    """df with the column `before`: the sum of `weight` over the rows of the same keys that come earlier in `order`.

    The order must be total within keys. Rows are sorted by range over all tasks, so that one key may
    hold any share of the rows: every piece is summed for itself and takes the totals of the pieces before it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__piece", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "__piece").agg(F.sum(weight).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__piece", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col("l.__piece") == F.col("o.__piece")]
    joined = local.alias("l").join(offsets.alias("o"), on=_all(same), how="inner")
    return joined.select("l.*", (F.col("o.__before") + F.col("l.__local")).alias(before)).drop("__piece", "__local")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
