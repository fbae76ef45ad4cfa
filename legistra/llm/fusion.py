"""One ranking from several scores of different scales, by reciprocal rank fusion.

Every score ranks the candidates of a query by itself; a candidate's total is the sum of 1 / (constant + rank).
Equal values share the better rank. A null or NaN score gives no support; a candidate without any score
stands last with a total of 0. Equal totals go by the smaller candidate id. Repeated rows count once.
A null query_id is a query of its own. The candidates of a query meet in one task, after a single exchange, and are ranked
there; queries that are found to hold very many rows are ranked over all tasks instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.scale import hot_keys, running_counts, salted_join

SCORES = {"bm25_score": True, "dense_score": True, "llm_score": True, "rerank_position": False}


def _value(c: str, more: bool) -> Column:
    """A score as a double of which more is better; null where it gives no support."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v if more else -v)


def _in_place(rows: DataFrame, group: str, item: str, scores: Mapping[str, bool], constant: float) -> DataFrame:
    """The totals of queries that a task can hold."""
    # rows of a query stay together from here on, so nothing below moves them again
    once = rows.repartition(F.col(group)).distinct()
    total = F.lit(0.0)
    # added up in a fixed order, so that the same ranks always give the same total
    for c, more in sorted(scores.items()):
        v = _value(c, more)
        rank = F.rank().over(Window.partitionBy(group).orderBy(v.desc_nulls_last()))
        total = total + F.when(v.isNotNull(), F.lit(1.0) / (F.lit(float(constant)) + rank)).otherwise(0.0)
    return once.select(group, item, total.alias("__part")).groupBy(group, item).agg(F.sum("__part").alias("total"))


def _spread(rows: DataFrame, group: str, item: str, scores: Mapping[str, bool], constant: float) -> DataFrame:
    """The totals of queries of any size: values are ranked by range over all tasks."""
    each = F.array(
        F.struct(F.lit("").alias("score"), F.lit(None).cast("double").alias("v")),
        *[F.struct(F.lit(c).alias("score"), _value(c, more).alias("v")) for c, more in scores.items()],
    )
    long = rows.distinct().select(group, item, F.inline(each))
    valid = F.col("v").isNotNull()
    values = long.where(valid).groupBy(group, "score", "v").agg(F.count("*").alias("n"))
    ranked = running_counts(values, [group, "score"], [F.col("v").desc()], "n", "better")
    tag = F.coalesce(F.col(group).cast("string"), F.lit("\u0000")).alias("__g")
    support = ranked.select(tag, "score", "v", (F.lit(1.0) / (F.lit(float(constant)) + F.col("better") + 1)).alias("support"))
    given = salted_join(long.where(valid).select("*", tag), support, ["__g", "score", "v"], by=[item]).select(group, item, "score", "support")
    unscored = long.where(F.col("score") == "").select(group, item, "score", F.lit(0.0).alias("support"))
    parts = given.unionByName(unscored).groupBy(group, item).agg(F.sort_array(F.collect_list(F.struct("score", "support"))).alias("parts"))
    return parts.select(group, item, F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["support"]).alias("total"))


def _parted(df: DataFrame, group: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of queries that a task can hold, and those of the very large ones, if there are any."""
    hot = list(hot_keys(df, [group]))
    if not hot:
        return df, None
    large = F.xxhash64(group).isin(hot)
    return df.where(~large), df.where(large)


def fused(candidates: DataFrame, group: str = "query_id", item: str = "cand_id", scores: Mapping[str, bool] = SCORES, constant: float = 60.0) -> DataFrame:
    """group, item, total. scores: column to whether more is better."""
    usual, large = _parted(candidates.select(group, item, *scores), group)
    out = _in_place(usual, group, item, scores, constant)
    return out if large is None else out.unionByName(_spread(large, group, item, scores, constant))


def first_of_each(totals: DataFrame, group: str = "query_id", item: str = "cand_id") -> DataFrame:
    """group, item: the candidate that stands first."""
    return totals.groupBy(group).agg(F.max(F.struct("total", (-F.col(item)).alias("back"))).alias("best")).select(group, (-F.col("best.back")).alias(item))


def fused_ranking(candidates: DataFrame, group: str = "query_id", item: str = "cand_id", scores: Mapping[str, bool] = SCORES, constant: float = 60.0) -> DataFrame:
    """group, item, total, position from 1."""
    usual, large = _parted(candidates.select(group, item, *scores), group)
    order = [F.col("total").desc(), F.col(item)]
    totals = _in_place(usual, group, item, scores, constant)
    out = totals.select(group, item, "total", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint").alias("position"))
    if large is not None:
        counted = _spread(large, group, item, scores, constant).withColumn("n", F.lit(1))
        placed = running_counts(counted, [group], order, "n", "earlier")
        out = out.unionByName(placed.select(group, item, "total", (F.col("earlier") + 1).alias("position")))
    return out.select(group, item, F.round("total", 9).alias("total"), "position")
