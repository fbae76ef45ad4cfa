"""References whose target does not exist at the time of the record.

Parents and children are brought into one long form, tagged, and grouped by parent table and key. A group
without a parent flag holds references to nothing (`missing`). Where the key is known, the times decide:
`late` if every target starts after the record, `deleted` if every target that had started had also ended.

Nulls and blanks are no keys, so they are no references and no targets. A record without a time can only be
`missing`; its period is null. A target without a start counts as always there, one without an end as still there.
Repeated rows give one result. Empty tables are fine: without targets every reference is `missing`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legistra.functions.ids import canonical_doc, canonical_node, gold_doc
from legistra.operators.scale import salted_join
from legistra.session import cut

FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def spans(targets: DataFrame) -> DataFrame:
    """targets (parent, key, starts_at, ends_at) with overlapping and touching spans of a key merged.

    The merging runs within a key and month first, so that a key with very many targets reaches the second
    pass with few spans.
    """
    clean = targets.select(
        "parent",
        "key",
        F.coalesce(F.col("starts_at").cast("timestamp_ntz"), F.lit(FIRST).cast("timestamp_ntz")).alias("starts_at"),
        F.coalesce(F.col("ends_at").cast("timestamp_ntz"), F.lit(LAST).cast("timestamp_ntz")).alias("ends_at"),
    ).where(F.col("key").isNotNull() & (F.col("ends_at") > F.col("starts_at")))

    def merged(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("starts_at", "ends_at")
        so_far = F.max("ends_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(so_far.isNull() | (F.col("starts_at") > so_far), 1).otherwise(0)
        marked = df.distinct().withColumn("__opens", opens)
        numbered = marked.withColumn("__no", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*keys, "__no").agg(F.min("starts_at").alias("starts_at"), F.max("ends_at").alias("ends_at")).drop("__no")

    by_month = merged(clean.withColumn("__month", F.date_trunc("month", "starts_at")), ["parent", "key", "__month"])
    return merged(by_month.drop("__month"), ["parent", "key"])


def find_orphans(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references with no target at their time, plus `reason` and `period`.

    references: parent, key, at and any columns that name the record. targets: parent, key, starts_at, ends_at;
    `parent` says which table and which field of it the key belongs to.
    """
    # both are read more than once, and their keys are dear
    refs = cut(references.where(F.col("key").isNotNull()).withColumn("at", F.col("at").cast("timestamp_ntz")).distinct())
    targets = cut(targets.where(F.col("key").isNotNull()).distinct())
    # targets that end no later than they start exist, though at no time
    known = targets.groupBy("parent", "key").agg(
        F.coalesce(F.min(F.coalesce(F.col("starts_at").cast("timestamp_ntz"), F.lit(FIRST).cast("timestamp_ntz")))).alias("first_start")
    )
    long_form = (
        known.select("parent", "key", F.lit(1).alias("is_parent"), "first_start", F.lit(None).cast("struct<starts_at:timestamp_ntz,ends_at:timestamp_ntz>").alias("span"))
        .unionByName(spans(targets).select("parent", "key", F.lit(1).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("first_start"), F.struct("starts_at", "ends_at").alias("span")))
        .unionByName(refs.select("parent", "key").distinct().select("parent", "key", F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("first_start"), F.lit(None).cast("struct<starts_at:timestamp_ntz,ends_at:timestamp_ntz>").alias("span")))
    )
    groups = long_form.groupBy("parent", "key").agg(
        F.max("is_parent").alias("is_parent"),
        F.min("is_parent").alias("no_child"),
        F.min("first_start").alias("first_start"),
        F.collect_list("span").alias("spans"),
    ).where("no_child = 0").drop("no_child")
    names = [c for c in refs.columns if c not in ("parent", "key")]
    judged = salted_join(refs, groups, ["parent", "key"], by=names)
    alive = F.exists("spans", lambda s: (s["starts_at"] <= F.col("at")) & (F.col("at") < s["ends_at"]))
    reason = (
        F.when(F.col("is_parent") == 0, "missing")
        .when(F.col("at").isNull() | alive, None)
        .when(F.col("first_start") > F.col("at"), "late")
        .otherwise("deleted")
    )
    return (
        judged.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .withColumn("period", F.date_format("at", "yyyy-MM"))
        .drop("is_parent", "first_start", "spans")
    )


def gt_references(gt_items: DataFrame) -> DataFrame:
    """The node references of the ground-truth records: gold_node_id and gold_anchor_node_id."""
    doc = F.coalesce(gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")), F.lit(""))

    def one(field: str, granularity) -> DataFrame:
        node = canonical_node(F.col(field))
        return gt_items.select(
            F.lit("nodes").alias("parent"),
            F.when(node.isNotNull(), F.concat_ws("\u0001", F.coalesce(granularity, F.lit("")), doc, node)).alias("key"),
            F.col("created_at").alias("at"),
            F.lit("gt_items").alias("src_table"),
            F.col("query_id").alias("src_id"),
            F.lit(field).alias("field_name"),
            node.alias("ref_key"),
        )

    anchor = F.lower(F.trim("gold_anchor_granularity"))
    return one("gold_node_id", F.lit("pasal")).unionByName(one("gold_anchor_node_id", anchor))


def node_targets(nodes: DataFrame) -> DataFrame:
    """The nodes as targets."""
    key = F.concat_ws("\u0001", F.lower(F.trim("granularity")), canonical_doc(F.col("doc_id")), canonical_node(F.col("node_id")))
    there = F.col("granularity").isNotNull() & canonical_doc(F.col("doc_id")).isNotNull() & canonical_node(F.col("node_id")).isNotNull()
    return nodes.select(F.lit("nodes").alias("parent"), F.when(there, key).alias("key"), F.col("loaded_at").alias("starts_at"), F.col("deleted_at").alias("ends_at"))


def plain_number(c):
    """An id without blanks and leading zeros; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"^0+(?=.)", ""), F.lit(""))


def registry_references(registry: DataFrame) -> DataFrame:
    """The ref_id of every relation in the registry."""
    rel = registry.select("scrape_id", "scraped_at", F.explode("relasi").alias("rel"))
    key = plain_number(F.col("rel.ref_id"))
    return rel.select(
        F.lit("registry").alias("parent"),
        key.alias("key"),
        F.col("scraped_at").alias("at"),
        F.lit("registry").alias("src_table"),
        F.col("scrape_id").alias("src_id"),
        F.lit("ref_id").alias("field_name"),
        key.alias("ref_key"),
    )


def registry_targets(registry: DataFrame) -> DataFrame:
    """The registry's entries as targets."""
    return registry.select(F.lit("registry").alias("parent"), plain_number(F.col("detail_id")).alias("key"), F.col("scraped_at").alias("starts_at"), F.col("removed_at").alias("ends_at"))


def corpus_orphans(gt_items: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """src_table, src_id, field_name, ref_key, reason, period of all orphan references of the project's tables."""
    references = gt_references(gt_items).unionByName(registry_references(registry))
    targets = node_targets(nodes).unionByName(registry_targets(registry))
    return find_orphans(references, targets).select("src_table", "src_id", "field_name", "ref_key", "reason", "period").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """How many orphan references a table, field, reason and period has, and to how many keys."""
    return orphans.groupBy("src_table", "field_name", "reason", "period").agg(
        F.count("*").alias("n_references"), F.count_distinct("ref_key").alias("n_keys")
    )
