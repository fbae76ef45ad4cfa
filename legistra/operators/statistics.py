"""Paired tests, bootstrap intervals and allocation of samples."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.scale import running_counts
from legistra.operators.summaries import unique_runs

# Bands of effect sizes.
BANDS = ((0.01, "trivial"), (0.2, "very small"), (0.5, "small"), (0.8, "medium"), (1.2, "large"), (2.0, "very large"))


def paired(runs: DataFrame, a: str, b: str, value: str = "elapsed_s") -> DataFrame:
    """query_id, eval_granularity, va, vb of what both systems answered without error: the mean of their runs."""
    ok = unique_runs(runs).where(f"coalesce(error, '') = '' and {value} >= 0 and query_id is not null")
    per = ok.groupBy("query_id", "eval_granularity").agg(
        F.avg(F.when(F.col("system") == a, F.col(value))).alias("va"), F.avg(F.when(F.col("system") == b, F.col(value))).alias("vb")
    )
    return per.where("va is not null and vb is not null")


def effect_label(d):
    """The name of an effect size."""
    out = F.lit("huge")
    for bound, name in reversed(BANDS):
        out = F.when(F.abs(d) < bound, name).otherwise(out)
    return out


def paired_test(pairs: DataFrame) -> DataFrame:
    """n, mean_diff, t, cohens_d, label per granularity; zero spread gives 0 and `zero-variance`."""
    g = pairs.withColumn("d", F.col("va") - F.col("vb")).groupBy("eval_granularity").agg(
        F.count("*").alias("n"), F.avg("d").alias("m"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("s")
    )
    flat = F.col("s") == 0
    d = F.when(flat, 0.0).otherwise(F.col("m") / F.when(flat, 1.0).otherwise(F.col("s")))
    return g.select(
        "eval_granularity", "n", F.round("m", 4).alias("mean_diff"), F.round(d * F.sqrt("n"), 4).alias("t"), F.round(d, 4).alias("cohens_d"),
        F.when(flat, "zero-variance").otherwise(effect_label(d)).alias("label"),
    )


def two_sided_p(t: float) -> float:
    """The normal approximation of a two-sided p value."""
    return 1 - math.erf(abs(t) / math.sqrt(2))


POISSON_STEPS = 13  # beyond it no hash of 32 bits lies


def bootstrap_hash(values: DataFrame, key: str, group: str, value: str, resamples: int = 200) -> DataFrame:
    """group, n, mean, low, high: a Poisson bootstrap whose weights come from hashes, so that it is the same everywhere.

    Every row weighs into a resample by the count that its hash draws; nothing is shuffled but sums per
    group and resample.
    """
    spread = values.select(group, value, F.md5(F.col(key).cast("string")).alias("__h"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "__h", F.col("r").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight, cumulative, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, POISSON_STEPS + 1):  # the Poisson quantile of u
        cumulative += term
        term /= k
        weight = weight + F.when(u >= round(cumulative, 12), 1).otherwise(0)
    sums = spread.withColumn("w", weight).groupBy(group, "r").agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.sum("w").alias("c"))
    means = sums.where("c > 0").withColumn("m", F.col("s") / F.col("c"))
    interval = means.groupBy(group).agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))
    plain = values.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
    return plain.join(interval, group)


def randomization_hash(pairs: DataFrame, key: str, rounds: int = 200) -> DataFrame:
    """n, p per granularity: how often randomly flipped differences are as far from 0; flips come from hashes."""
    d = pairs.withColumn("d", F.round(F.col("va") - F.col("vb"), 6))
    spread = d.select("eval_granularity", key, "d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    flip = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("r").cast("string"))), 1, 1).isin(*"01234567")
    sums = spread.groupBy("eval_granularity", "r").agg(F.round(F.sum(F.when(flip, -F.col("d")).otherwise(F.col("d"))), 4).alias("s"))
    real = d.groupBy("eval_granularity").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("s0"))
    far = sums.join(real, "eval_granularity").groupBy("eval_granularity", "n").agg(F.sum((F.abs("s") >= F.abs("s0")).cast("int")).alias("c"))
    return far.select("eval_granularity", "n", F.round((F.col("c") + 1) / (rounds + 1), 4).alias("p"))


def bootstrap_seeded(values: DataFrame, group: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """group, n, mean, low, high by the classic bootstrap with a seeded generator; one group a task, for small groups."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = sorted(pdf[value].dropna().tolist())
        n, rng = len(x), random.Random(seed)
        if n < 2:
            return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [n], "mean": [x[0] if x else 0.0], "low": [0.0], "high": [0.0]})
        means = sorted(sum(rng.choices(x, k=n)) / n for _ in range(resamples))
        low, high = means[int(0.025 * resamples)], means[max(0, int(0.975 * resamples) - 1)]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [n], "mean": [sum(x) / n], "low": [low], "high": [high]})

    return values.groupBy(group).applyInPandas(one, f"{group} string, n bigint, mean double, low double, high double")


def compared(pairs: DataFrame, key: str) -> DataFrame:
    """eval_granularity, n, by_t, by_randomization, agree: whether two tests call a difference real at 5 %.

    The t test by the normal's limit, as pairs are many; pairs without spread are never different by it.
    """
    t = paired_test(pairs).select("eval_granularity", "n", (F.abs("t") > 1.959964).alias("by_t"))
    r = randomization_hash(pairs, key).select("eval_granularity", (F.col("p") < 0.05).alias("by_randomization"))
    return t.join(r, "eval_granularity").withColumn("agree", F.col("by_t") == F.col("by_randomization"))


def largest_remainder(groups: DataFrame, key: str, total: str, shares: list[tuple[str, float]]) -> DataFrame:
    """key, part, n: whole numbers that add up to total, floors first, what is left by the largest fraction, then order."""
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("part"), F.lit(float(s)).alias("share")) for i, (name, s) in enumerate(shares)])
    each = groups.select(key, F.col(total).alias("t"), F.inline(parts)).withColumn("x", F.round(F.col("t") * F.col("share"), 9)).withColumn("base", F.floor("x"))
    w, order = Window.partitionBy(key), Window.partitionBy(key).orderBy((F.col("x") - F.col("base")).desc(), "i")
    left = each.withColumn("left", F.col("t") - F.sum("base").over(w)).withColumn("place", F.row_number().over(order))
    return left.select(key, "part", (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("n"))


def stratified_pick(df: DataFrame, group: str, key: str, size: str, n: int, seed: str = "42") -> DataFrame:
    """group, key, stratum: one of each of n equal strata by size, the one with the lowest hash; all if there are no more than n."""
    numbered = running_counts(df.select(group, key, size, F.lit(1).alias("one")), [group], [F.col(size), F.col(key)], "one", "i")
    ranked = numbered.join(df.groupBy(group).agg(F.count("*").alias("t")), group)
    stratum = F.when(F.col("t") <= n, F.col("i")).otherwise(F.floor((F.col("i") * n + n - 1) / F.col("t")))
    placed = ranked.withColumn("stratum", F.least(stratum, F.lit(n - 1)).cast("int"))
    best = placed.groupBy(group, "stratum").agg(F.min_by(key, F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key))).alias(key))
    return best.select(group, key, "stratum")


def cell_allocation(cells: DataFrame, key: list[str], total: str) -> DataFrame:
    """key, n_train, n_val, n_test of each cell: one goes to train, of two the second by turns, more by 40, 30, 30."""
    t = F.col(total)
    turn = F.row_number().over(Window.partitionBy(F.col(total) == 2).orderBy(*key)) % 2
    third = lambda share: F.floor(F.round(t * share, 9))
    base = third(0.4) + third(0.3) + third(0.3)
    left = t - base
    # fractions decide over what is left; equal ones go in order
    f = F.array(*[F.struct((-(F.round(t * s, 9) - third(s))).alias("f"), F.lit(i).alias("i")) for i, s in enumerate((0.4, 0.3, 0.3))])
    winners = F.transform(F.array_sort(f), lambda x: x["i"])
    extra = lambda i: F.when((F.array_position(winners, F.lit(i)) <= left), 1).otherwise(0)
    big = [third(s) + extra(i) for i, s in enumerate((0.4, 0.3, 0.3))]
    one, two = t == 1, t == 2
    return cells.select(
        *key, F.col(total).alias("n_total"),
        F.when(one | two, 1).otherwise(big[0]).cast("bigint").alias("n_train"),
        F.when(one, 0).when(two, F.when(turn == 1, 1).otherwise(0)).otherwise(big[1]).cast("bigint").alias("n_val"),
        F.when(one, 0).when(two, F.when(turn == 1, 0).otherwise(1)).otherwise(big[2]).cast("bigint").alias("n_test"),
    )


def greedy_parts(lengths: DataFrame, group: str, order: str, length: str, budget: int) -> DataFrame:
    """group, order, part: items put together in order while a part stays within the budget; a larger item is alone."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group_now, part, used = None, 0, 0
        for pdf in frames:
            parts = []
            for g, n in zip(pdf[group], pdf[length], strict=True):
                if g != group_now:
                    group_now, part, used = g, 1, 0
                elif used + n > budget and used:
                    part, used = part + 1, 0
                used += n
                parts.append(part)
            yield pd.DataFrame({group: pdf[group], order: pdf[order], "part": parts})

    rows = lengths.select(group, order, length).repartition(group).sortWithinPartitions(group, order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(one, f"{group} {kinds[group]}, {order} {kinds[order]}, part bigint")


def rebalanced(cells: list[dict[str, int]], totals: dict[str, int]) -> list[dict[str, int]]:
    """Cells whose parts add up to the wanted totals: one unit at a time moves inside a cell, from parts with too much.

    The largest cells give first. Cells are few (types by categories), so this runs on the driver; it raises ValueError if
    the totals can't be reached.
    """
    out = [dict(c) for c in cells]
    if sum(totals.values()) != sum(sum(c.values()) for c in out):
        raise ValueError("the totals don't add up to the cells")
    while True:
        over = {p: sum(c[p] for c in out) - totals[p] for p in totals}
        donor = max(sorted(over), key=lambda p: over[p])
        taker = min(sorted(over), key=lambda p: over[p])
        if not over[donor]:
            return out
        able = [c for c in out if c[donor] > 0]
        if not able:
            raise ValueError("no cell can give")
        cell = max(able, key=lambda c: (c[donor], sum(c.values())))
        cell[donor] -= 1
        cell[taker] += 1
