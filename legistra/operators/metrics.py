"""Metrics of ranked lists, per query and summed up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legistra.operators.corpus_tables import parent_prefix

CUTOFFS = (1, 3, 5, 10)


def ranked_unique(ranked: DataFrame, item: str) -> DataFrame:
    """query_id, item, rank: empty items dropped, repeats at their first place, ranks closed up."""
    from pyspark.sql import Window

    first = ranked.where(f"{item} is not null and {item} <> ''").groupBy("query_id", item).agg(F.min("rank").alias("at"))
    return first.select("query_id", item, F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank"))


def per_query(ranked: DataFrame, gold: DataFrame, item: str, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """query_id, k, hit, recall, precision, f1, ndcg, map, mrr, first_rank of every query in gold.

    ranked: query_id, item, rank, each item once. gold: query_id, item. Recall and map divide by all relevant items,
    precision by k; a query without ranked items gets zeros and a null first_rank.
    """
    relevant = gold.select("query_id", item).distinct()
    n_rel = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(relevant, ["query_id", item], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    base = n_rel.join(hits, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    each = base.select("query_id", "n_rel", F.try_element_at("ranks", F.lit(1)).alias("first_rank"), "ranks", F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k"))
    top = F.filter("ranks", lambda r: r <= F.col("k"))
    e = each.withColumn("top", top).withColumn("n", F.size("top"))
    gain = lambda r: F.lit(1.0) / F.log2(r.cast("double") + 1)
    dcg = F.aggregate("top", F.lit(0.0), lambda s, r: s + gain(r))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", "k").cast("int")), F.lit(0.0), lambda s, r: s + gain(r))
    precisions = F.aggregate(F.transform("top", lambda r, i: (i + 1).cast("double") / r), F.lit(0.0), lambda s, x: s + x)
    recall, precision = F.col("n") / F.col("n_rel"), F.col("n").cast("double") / F.col("k")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return e.select(
        "query_id", "k", F.when(F.col("n") > 0, 1).otherwise(0).alias("hit"), r6(recall, "recall"), r6(precision, "precision"),
        r6(F.when(F.col("n") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), "f1"),
        r6(dcg / ideal, "ndcg"), r6(precisions / F.col("n_rel"), "map"),
        r6(F.when(F.col("first_rank") <= F.col("k"), 1.0 / F.col("first_rank")).otherwise(0.0), "mrr"), "first_rank",
    )


def sibling_hits(ranked: DataFrame, gold: DataFrame, item: str, k: int = 10) -> DataFrame:
    """query_id, sibling_hit: whether an item in the top k that isn't relevant shares its parent with one that is."""
    relevant = gold.select("query_id", item).distinct()
    parents = relevant.select("query_id", parent_prefix(F.col(item)).alias("parent")).where("parent <> ''").distinct()
    others = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", item], "left_anti").select("query_id", parent_prefix(F.col(item)).alias("parent"))
    near = others.join(parents, ["query_id", "parent"], "left_semi").select("query_id").distinct().withColumn("sibling_hit", F.lit(1))
    return relevant.select("query_id").distinct().join(near, "query_id", "left").select("query_id", F.coalesce("sibling_hit", F.lit(0)).alias("sibling_hit"))


def rank_distribution(metrics: DataFrame) -> DataFrame:
    """n, n_found, mean, median and largest of the first relevant ranks. metrics: per_query at one cutoff."""
    return metrics.agg(
        F.count("*").alias("n"), F.count("first_rank").alias("n_found"), F.round(F.avg("first_rank"), 6).alias("mean_rank"),
        F.round(F.percentile("first_rank", F.lit(0.5)), 6).alias("median_rank"), F.max("first_rank").alias("max_rank"),
    )
