"""Grouped summaries of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.corpus_tables import newest
from legistra.operators.scale import running_counts

# Substrings of error texts, the first class that matches wins; & stands between two that must both be there.
ERROR_CLASSES = (
    ("missing-index", ("errno 2", "no such file", "filenotfound")),
    ("llm-empty", ("no relevant",)),
    ("rate-limit", ("429", "quota", "resource_exhausted", "rate limit", "too many requests")),
    ("network", (
        "getaddrinfo", "connection", "timed out", "timeout", "dns", "unreachable", "reset by peer", "eof occurred",
        "500", "502", "503", "504", "service unavailable", "overloaded",
    )),
    ("worker-crash", ("json&decode", "json&invalid", "non-json", "worker exited")),
)
# Seconds to wait before the first and the later tries again; other classes are not tried again.
BACKOFF = {"rate-limit": (30, 90), "network": (15, 45), "worker-crash": (15, 45)}
# Price of a million tokens, input and output, by model.
PRICES = (("model-a", 0.15, 0.6), ("model-b", 0.8, 4.0))


def unique_runs(runs: DataFrame) -> DataFrame:
    """Runs, a repeated run_id once: the one logged last."""
    return newest(runs.where("run_id is not null"), ["run_id"], ["logged_at", "started_at"])


def failed(error: Column) -> Column:
    return F.coalesce(error != "", F.lit(False))


def error_class(error: Column) -> Column:
    """The class of an error text; null for none, `other` for an unknown one."""
    low, out = F.lower(error), F.lit("other")
    for name, parts in reversed(ERROR_CLASSES):
        hit = F.lit(False)
        for p in parts:
            every = F.lit(True)
            for piece in p.split("&"):
                every = every & F.contains(low, F.lit(piece))
            hit = hit | every
        out = F.when(hit, name).otherwise(out)
    return F.when(failed(error), out)


def combo_summary(runs: DataFrame) -> DataFrame:
    """Per system and granularity: runs, errors, mean time, tokens and calls; nulls count as 0, errors included."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return unique_runs(runs).groupBy("system", "eval_granularity").agg(
        F.count("*").alias("n"),
        F.sum(failed(F.col("error")).cast("bigint")).alias("n_errors"),
        F.round(F.avg(zero("elapsed_s")), 8).alias("mean_elapsed_s"),
        F.round(F.avg(zero("total_tokens")), 8).alias("mean_tokens"),
        F.round(F.avg(zero("llm_calls")), 8).alias("mean_calls"),
    )


SLICES = ("reference_mode", "query_style", "gold_doc_id", "query_type")


def slices(runs: DataFrame, gt_items: DataFrame) -> DataFrame:
    """Runs and successes by each of four fields of the question by itself: slice, value, n, success_rate; null as ''."""
    fields = SLICES
    about = gt_items.groupBy("query_id").agg(*[F.min(f).alias(f) for f in ("reference_mode", "query_style")])
    joined = unique_runs(runs).join(about, "query_id", "left")
    r = joined.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields], F.col("worker_ok").cast("double").alias("ok"))
    each = r.select("ok", F.inline(F.array(*[F.struct(F.lit(f).alias("slice"), F.col(f).alias("value")) for f in fields])))
    return each.groupBy("slice", "value").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("ok", F.lit(1.0))), 4).alias("success_rate"))


def totals(runs: DataFrame) -> DataFrame:
    """Tokens and calls rolled up: by system and granularity, by system, and over all; null where rolled up."""
    return unique_runs(runs).where("coalesce(worker_ok, true)").rollup("system", "eval_granularity").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("llm_calls", F.lit(0))).alias("calls"),
    )


def interpolated_percentiles(runs: DataFrame) -> DataFrame:
    """p50, p95 and p99 of elapsed_s per system, between neighbours in proportion.

    Values are placed by range over all tasks, so a system may hold any share of the runs.
    """
    kept = unique_runs(runs).where("elapsed_s >= 0").groupBy("system", "elapsed_s").agg(F.count("*").alias("c"))
    placed = running_counts(kept, ["system"], [F.col("elapsed_s")], "c", "before")
    totals = kept.groupBy("system").agg(F.sum("c").alias("n"))
    same = F.col("p.system").eqNullSafe(F.col("t.system"))
    both = placed.alias("p").join(F.broadcast(totals).alias("t"), same).select("p.*", "n")  # a row a system

    def value(q: float) -> Column:
        at = F.lit(q) * (F.col("n") - 1)
        holds = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("c")), F.col("elapsed_s")))
        low, high, share = holds(F.floor(at)), holds(F.ceil(at)), F.max(at - F.floor(at))
        return F.round(low + (high - low) * share, 8).alias(f"p{round(100 * q)}")

    return both.groupBy("system").agg(*[value(q) for q in (0.5, 0.95, 0.99)])


def nearest_percentiles(runs: DataFrame) -> DataFrame:
    """The values of total_tokens per system at places floor(n * q) from 0, as they stand."""
    kept = unique_runs(runs).where("total_tokens >= 0")
    counted = kept.groupBy("system", "total_tokens").agg(F.count("*").alias("c"))
    w = Window.partitionBy("system").orderBy("total_tokens")
    placed = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("system")))
    at = lambda q: F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1)
    holds = lambda q: (F.col("upto") > at(q)) & (F.col("upto") - F.col("c") <= at(q))
    return placed.groupBy("system").agg(
        F.max(F.when(holds(0.5), F.col("total_tokens"))).alias("median_upper"), F.max(F.when(holds(0.95), F.col("total_tokens"))).alias("p95")
    )


def retry_plan(runs: DataFrame) -> DataFrame:
    """run_id, error_class, retryable, wait_s: what is to be done about a run that failed, by its class and the tries it had."""
    r = unique_runs(runs).withColumn("error_class", error_class(F.col("error"))).where("error_class is not null")
    wait = F.lit(None).cast("int")
    for name, (first, later) in BACKOFF.items():
        wait = F.when(F.col("error_class") == name, F.when(F.coalesce("retry_count", F.lit(0)) == 0, first).otherwise(later)).otherwise(wait)
    return r.select("run_id", "error_class", wait.isNotNull().alias("retryable"), wait.alias("wait_s"))


def errors_by_class(runs: DataFrame) -> DataFrame:
    """error_class, system, n of runs with an error."""
    r = unique_runs(runs).withColumn("error_class", error_class(F.col("error")))
    return r.where("error_class is not null").groupBy("error_class", "system").agg(F.count("*").alias("n"))


def token_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """What the tokens of each model cost. prices: llm_model, input_price, output_price of a million tokens."""
    per = unique_runs(runs).where("llm_model is not null").groupBy("llm_model").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens")
    )
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return per.join(F.broadcast(prices), "llm_model", "left").select("llm_model", "input_tokens", "output_tokens", F.round(F.coalesce(cost, F.lit(0.0)), 4).alias("cost"))


def cost_by_style(runs: DataFrame, gt_items: DataFrame) -> DataFrame:
    """Mean tokens and time by the style of the query; `unknown` where it is missing."""
    style = gt_items.groupBy("query_id").agg(F.min("query_style").alias("query_style"))
    r = unique_runs(runs).join(style, "query_id", "left").withColumn("query_style", F.coalesce("query_style", F.lit("unknown")))
    return r.groupBy("query_style").agg(
        F.count("*").alias("n"), F.round(F.avg("total_tokens"), 8).alias("mean_tokens"), F.round(F.avg("elapsed_s"), 8).alias("mean_elapsed_s")
    )


def retries(runs: DataFrame) -> DataFrame:
    """Per system: whether a run repeats the outcome of the system's last run on the same query, counted."""
    w = Window.partitionBy("system", "query_id").orderBy("started_at", "run_id")
    r = unique_runs(runs).withColumn("before", F.lag("worker_ok").over(w)).where("before is not null")
    return r.groupBy("system").agg(F.count("*").alias("n_repeats"), F.sum((F.col("before") == F.col("worker_ok")).cast("bigint")).alias("n_same_outcome"))


def gt_statistics(gt_items: DataFrame) -> DataFrame:
    """Questions by type, style and mode, with distinct anchors."""
    return gt_items.groupBy("query_type", "query_style", "reference_mode").agg(
        F.count_distinct("query_id").alias("n_queries"), F.count_distinct("gold_anchor_node_id").alias("n_anchors")
    )


def type_by_mode(gt_items: DataFrame) -> DataFrame:
    """A table of query types against reference modes."""
    modes = ["none", "legal_ref", "doc_only", "both"]
    kept = gt_items.select("query_id", "query_type", "reference_mode").distinct()
    return kept.groupBy("query_type").pivot("reference_mode", modes).count().select("query_type", *[F.coalesce(m, F.lit(0)).alias(m) for m in modes])


def fingerprints(splits: DataFrame) -> DataFrame:
    """The SHA-256 of each split's ids, in order, one a line."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("query_id")), lambda x: x.cast("string")), "\n")
    return splits.where("split_name is not null").groupBy("split_name").agg(F.count_distinct("query_id").alias("n"), F.sha2(ids, 256).alias("fingerprint"))


def corpus_status(registry: DataFrame, nodes: DataFrame, tree_docs: DataFrame) -> DataFrame:
    """Per folder: documents, with PDF, still there, indexed, only fetched, and neither."""
    reg = newest(registry.where("doc_id is not null"), ["doc_id"], ["scraped_at", "scrape_id"])
    indexed = nodes.select("doc_id").distinct().withColumn("indexed", F.lit(1))
    fetched = tree_docs.select("doc_id").distinct().withColumn("fetched", F.lit(1))
    all_ = reg.join(indexed, "doc_id", "left").join(fetched, "doc_id", "left")
    i, f = F.coalesce("indexed", F.lit(0)), F.coalesce("fetched", F.lit(0))
    n = lambda c: F.sum(c.cast("bigint"))
    return all_.groupBy("jenis_folder").agg(
        F.count("*").alias("n_docs"), n(F.coalesce("has_pdf", F.lit(False))).alias("n_pdf"), n(F.col("removed_at").isNull()).alias("n_there"),
        n(i == 1).alias("n_indexed"), n((i == 0) & (f == 1)).alias("n_only_fetched"), n((i == 0) & (f == 0)).alias("n_neither"),
    )
