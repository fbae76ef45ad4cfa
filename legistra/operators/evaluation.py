"""Records of evaluation runs and their full summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.metrics import per_query, ranked_unique, sibling_hits
from legistra.operators.summaries import error_class, failed, unique_runs

MEASURES = ("elapsed_s", "total_tokens", "input_tokens", "output_tokens", "llm_calls")
QUANTILES = (50, 95, 99)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per system and granularity: runs, errors, means, totals and percentiles of what the runs took; nulls count as 0, errors included.

    Percentiles lie between neighbours in proportion. Values are counted before they are ordered, so a group is as large
    as its distinct values.
    """
    zero = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in MEASURES}
    aggs = [F.count("*").alias("num_queries"), F.sum(failed(F.col("error")).cast("bigint")).alias("error_count")]
    for m in MEASURES:
        aggs += [F.round(F.avg(zero[m]), 8).alias(f"avg_{m}"), F.round(F.sum(zero[m]), 4).alias(f"total_{m}")]
        aggs += [F.round(F.percentile(zero[m], F.lit(p / 100)), 6).alias(f"p{p}_{m}") for p in QUANTILES]
    return unique_runs(runs).groupBy("system", "eval_granularity").agg(*aggs)


def query_records(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id and all metrics of its list at one cutoff: per_query's, whether a sibling was met, the reciprocal rank whatever
    the cutoff, whether the first is right, and the same within the gold documents. ranked, gold: query_id, item as doc/node.
    """
    doc = lambda d: d.withColumn("doc", F.substring_index("item", "/", 1))
    base = per_query(ranked, gold, "item", (k,)).drop("k")
    strip = lambda d: d.withColumn("item", F.substring_index("item", "/", -1))
    sib = sibling_hits(ranked_unique(strip(ranked), "item"), strip(gold), "item", k)
    golden = doc(gold).select("query_id", "doc").distinct()
    inside = doc(ranked).join(golden, ["query_id", "doc"], "left_semi")
    again = inside.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))
    within = per_query(again, gold, "item", (k,)).select("query_id", F.col("hit").alias("within_doc_hit"), F.col("recall").alias("within_doc_recall"), F.col("mrr").alias("within_doc_mrr"))
    picked = inside.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("doc_pick_count"))
    first = F.col("first_rank")
    out = base.join(sib, "query_id", "left").join(within, "query_id", "left").join(picked, "query_id", "left")
    return out.withColumns({
        "sibling_hit": F.coalesce("sibling_hit", F.lit(0)), "doc_pick_count": F.coalesce("doc_pick_count", F.lit(0)),
        "doc_pick_hit": F.when(F.col("doc_pick_count") > 0, 1).otherwise(0), "full_rr": F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6),
        "top1": F.when(first == 1, 1).otherwise(0),
    })


SUMMED = ("hit", "recall", "precision", "f1", "ndcg", "map", "mrr", "sibling_hit", "full_rr", "top1", "doc_pick_hit", "doc_pick_count", "within_doc_hit", "within_doc_recall", "within_doc_mrr")


def summary_of(records: DataFrame, by: list[str]) -> DataFrame:
    """Means of the records' metrics; the recall within documents also over those records whose document was picked, else 0."""
    oracle = F.avg(F.when(F.col("doc_pick_hit") > 0, F.col("within_doc_recall").cast("double")))
    return records.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(F.col(m).cast("double")), F.lit(0.0)), 4).alias(m) for m in SUMMED],
        F.round(F.coalesce(oracle, F.lit(0.0)), 4).alias("oracle_within_doc_recall"), F.count("first_rank").alias("hits_anywhere"),
    )


def by_slices(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """slice, value, n, hit, recall, mrr: the records by each field by itself; null as ''."""
    each = F.array(*[F.struct(F.lit(f).alias("slice"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields])
    long = records.select("hit", "recall", "mrr", F.inline(each))
    return long.groupBy("slice", "value").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in ("hit", "recall", "mrr")])


def final_overview(runs: DataFrame) -> DataFrame:
    """part, name, n, share: runs by system and granularity, all runs, and failures by class, in one table of shares of all runs."""
    r = unique_runs(runs).withColumn("cls", error_class(F.col("error")))
    combos = r.groupBy(F.concat_ws("__", "system", "eval_granularity").alias("name")).agg(F.count("*").alias("n")).select(F.lit("combo").alias("part"), "name", "n")
    whole = r.agg(F.count("*").alias("n")).select(F.lit("overall").alias("part"), F.lit("").alias("name"), "n")
    failures = r.where("cls is not null").groupBy(F.col("cls").alias("name")).agg(F.count("*").alias("n")).select(F.lit("failure").alias("part"), "name", "n")
    total = whole.select(F.col("n").alias("t"))
    # one row
    return combos.unionByName(whole).unionByName(failures).crossJoin(F.broadcast(total)).select("part", "name", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def step_costs(runs: DataFrame) -> DataFrame:
    """system, step, n, tokens, seconds: what the steps took. Runs that call a model have `model`, the others one step `total`.

    The tokens of a step are those put in and out; a run without steps has its total.
    """
    with_steps = F.coalesce(F.col("llm_calls") > 0, F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tokens = F.when(with_steps, zero("input_tokens") + zero("output_tokens")).otherwise(zero("total_tokens"))
    r = unique_runs(runs).select("system", F.when(with_steps, "model").otherwise("total").alias("step"), tokens.alias("t"), F.coalesce("elapsed_s", F.lit(0.0)).alias("s"))
    return r.groupBy("system", "step").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.round(F.sum("s"), 4).alias("seconds"))
