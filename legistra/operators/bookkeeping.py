"""Small operators around runs and records: sealed splits, references by node, hints, signatures, overrides, costs of stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_members(splits: DataFrame, name: str, allow_test: bool = False) -> DataFrame:
    """query_id of a split. The test split stays sealed unless it is asked for with allow_test."""
    if name == "test" and not allow_test:
        raise PermissionError("the test split is sealed")
    return splits.where((F.col("split_name") == name) & F.col("query_id").isNotNull()).select("query_id").distinct()


def resolved_refs(ranking: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, ref, rank: a ranking of node ids as references, doc/node.

    ranking: query_id, node, pos; candidates: query_id, ref, rank. A node takes its first candidate with that id; the same id
    in other documents comes after all of these, and then what the ranking left out, both in the candidates' order.
    """
    named = candidates.withColumn("node", F.substring_index("ref", "/", -1))
    first = ranking.groupBy("query_id", "node").agg(F.min("pos").alias("pos"))
    met = named.join(first, ["query_id", "node"], "left")
    nth = F.row_number().over(Window.partitionBy("query_id", "node").orderBy("rank"))
    group = F.when(F.col("pos").isNull(), 2).when(F.col("nth") == 1, 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy("group", F.when(F.col("group") == 0, F.col("pos")).otherwise(F.col("rank")))
    placed = met.withColumn("nth", nth).withColumn("group", group)
    return placed.select("query_id", "ref", F.row_number().over(order).alias("place")).withColumnRenamed("place", "rank")


def budget_hints(steps: DataFrame, actions: int, reads: int) -> DataFrame:
    """query_id, step, hint: the steps at which an agent is told that its budget runs low: six tenths of the actions, seven of the reads.

    steps: query_id, step, action. After a submit nothing is said.
    """
    by = Window.partitionBy("query_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumns({
        "a": F.count("*").over(by), "r": F.sum((F.col("action") == "read").cast("int")).over(by), "s": F.max((F.col("action") == "submit").cast("int")).over(by),
    })
    hint = F.when(F.col("a") >= int(0.6 * actions), "actions").when(F.col("r") >= int(0.7 * reads), "reads")
    return counted.where("s = 0").select("query_id", "step", hint.alias("hint")).where("hint is not null")


def signature(fields: Sequence[str]) -> Column:
    """One value for the settings in some fields, nulls told from empty texts."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("\u0002")) for f in fields]))


def with_overrides(items: DataFrame, overrides: DataFrame, on: list[str], values: Mapping[str, str]) -> DataFrame:
    """items with the fields in values: those of the first matching override, else the defaults. overrides: a fixed list of few rows."""
    marked = overrides.select(*on, *[F.col(v).alias(f"__{v}") for v in values])
    met = items.join(F.broadcast(marked.dropDuplicates(on)), on, "left")
    return met.withColumns({v: F.coalesce(f"__{v}", F.lit(default)) for v, default in values.items()}).drop(*[f"__{v}" for v in values])


def stage_costs(log: DataFrame, stages: Sequence[str], once: str, first: str) -> DataFrame:
    """category, stage, n_docs, total, mean: what the stages cost, by category and over all (category null).

    log: category, doc_id, granularity and a column a stage; nulls count as 0. The stage `once` is the same work for every
    granularity, so only that of `first` counts.
    """
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias("cost")) for s in stages])
    long = log.select("category", "doc_id", "granularity", F.inline(each)).where((F.col("stage") != once) | (F.col("granularity") == first))
    per_doc = long.groupBy("category", "stage", "doc_id").agg(F.sum("cost").alias("cost"))
    sums = [F.count("*").alias("n_docs"), F.round(F.sum("cost"), 2).alias("total"), F.round(F.avg("cost"), 2).alias("mean")]
    return per_doc.groupBy("category", "stage").agg(*sums).unionByName(per_doc.groupBy("stage").agg(*sums).withColumn("category", F.lit(None).cast("string")))


# What a warning says, and its class; the first that is found counts.
WARNINGS = (("appears after", "order"), ("Gap in Pasal", "gap"), ("Failed to parse LLM", "model"))


def warning_class(text: Column) -> Column:
    """The class of a warning, `other` for an unknown one."""
    out = F.lit("other")
    for part, name in reversed(WARNINGS):
        out = F.when(F.contains(text, F.lit(part)), name).otherwise(out)
    return out


def previous_versions(loads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row before the last of each key in order: what a restore brings back. Keys with a single row have none."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return loads.withColumn("__n", F.row_number().over(w)).where("__n = 2").drop("__n")


def file_type(stem: Column, default: str = "factual") -> Column:
    """The kind after the first double underscore of a file stem, or the default."""
    return F.when(F.instr(stem, "__") > 0, F.split(stem, "__", 2)[1]).otherwise(F.lit(default))


def seeded_sample(items: DataFrame, group: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each group, those with the lowest seeded hashes of their keys: the sample is the feature."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
