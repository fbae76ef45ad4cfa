"""Train, validation and test splits that keep related records together.

Records are tied by a shared document or the same query, also by way of others. Documents are the vertices;
ties are edges between them. Borůvka's rounds contract every component along its lowest edge, strongest ties
first, until no edge is left; the chosen edges are a spanning forest, which is kept as a table. The number of
rounds is at most the logarithm of the number of documents, and every step is an aggregation or a join on
component ids, salted where one component holds most edges. Nothing about components reaches the driver but
counts.

The components are dealt to the splits within bands of like size, the largest first: in hashed order, by their position
among the band's records, in proportion to what every split still lacks of its share of all records. So each band makes up
for what the larger ones could not divide, and the smallest components settle the proportions.

A null or blank query ties nothing. A record without any document is tied by its query alone; its group_doc is
the smallest document of its group, or null if there is none. Repeated rows count once. A null query_id is a record.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legistra.functions.ids import gold_docs
from legistra.operators.scale import running_counts, salted_join
from legistra.session import cut, persist_table

PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def query_key(c: Column) -> Column:
    """The letters and digits of a query in lower case; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def record_vertices(gt_items: DataFrame) -> DataFrame:
    """record, query_key, vertices: the documents a record names, or its query, or itself."""
    docs = F.transform(gold_docs(F.col("gold_doc_id"), F.col("gold_doc_ids")), lambda d: F.concat(F.lit("d:"), d))
    named = gt_items.select("query_id", query_key(F.col("query")).alias("query_key"), docs.alias("docs"))
    alone = F.coalesce(F.concat(F.lit("q:"), F.md5("query_key")), F.concat(F.lit("r:"), F.coalesce(F.col("query_id").cast("string"), F.lit(""))))
    return named.select("query_id", "query_key", F.when(F.size("docs") > 0, F.array_sort("docs")).otherwise(F.array(alone)).alias("vertices")).distinct()


def tie_edges(records: DataFrame) -> DataFrame:
    """u < v, weight: edges between vertices; the more ties, the lower the weight.

    The vertices of a record, and those of records with the same query, are tied to the smallest one.
    """
    within = records.select(F.col("vertices")[0].alias("u"), F.explode("vertices").alias("v"))
    anchors = records.where("query_key is not null").select(F.md5("query_key").alias("k"), F.col("vertices")[0].alias("v")).distinct()
    smallest = anchors.groupBy("k").agg(F.min("v").alias("u"), F.count("*").alias("m")).where("m > 1").select("k", "u")
    across = salted_join(anchors, smallest, ["k"], by=["v"]).select("u", "v")
    both = within.unionByName(across).where("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("u", "v").agg((-F.count("*")).alias("weight"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (u, v, weight, round) as a kept table, and label (vertex, root) of its components.

    Vertices without edges have no label.
    """
    live = cut(edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "weight", "u", "v"))
    labels = cut(edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct().withColumn("root", F.col("vertex")))
    n_vertices = labels.count()
    forest: DataFrame | None = None
    number = 0
    while n_edges := live.count():
        number += 1
        rank = F.struct("weight", "u", "v")
        ways = live.select(F.col("cu").alias("c"), F.struct(rank.alias("rank"), F.col("cv").alias("other")).alias("way")).unionByName(
            live.select(F.col("cv").alias("c"), F.struct(rank.alias("rank"), F.col("cu").alias("other")).alias("way"))
        )
        lowest = cut(ways.groupBy("c").agg(F.min("way").alias("way")).select("c", "way.rank", F.col("way.other").alias("other")))
        chosen = lowest.select("rank.u", "rank.v", "rank.weight", F.lit(number).alias("round")).distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        # edges are totally ordered, so hooks form trees whose only cycles are two components that chose the same edge
        back = lowest.select(F.col("c").alias("other"), F.col("other").alias("its_other"))
        hooks = lowest.select("c", "other").join(back, "other", "inner")
        parent = cut(hooks.select("c", F.when((F.col("its_other") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("p")))
        moved = 1
        while moved:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = cut(salted_join(parent, up, ["p"], by=["c"], rows=n_vertices).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            parent = jumped.select("c", "p")
        labels = cut(salted_join(labels.withColumnRenamed("root", "c"), parent, ["c"], by=["vertex"], how="left", rows=n_vertices).select("vertex", F.coalesce("p", "c").alias("root")))
        left = salted_join(live, parent.select(F.col("c").alias("cu"), F.col("p").alias("ru")), ["cu"], by=["u", "v"], rows=n_edges)
        both = salted_join(left, parent.select(F.col("c").alias("cv"), F.col("p").alias("rv")), ["cv"], by=["u", "v"], rows=n_edges).where("ru <> rv")
        # of parallel edges between two components only the lowest can ever be chosen
        live = cut(
            both.select(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv"), F.struct("weight", "u", "v").alias("e"))
            .groupBy("cu", "cv")
            .agg(F.min("e").alias("e"))
            .select("cu", "cv", "e.weight", "e.u", "e.v")
        )
    if forest is None:
        forest = edges.select("u", "v", "weight", F.lit(0).alias("round")).limit(0)
    return persist_table(forest, "spanning-forest"), labels


def related_groups(gt_items: DataFrame) -> DataFrame:
    """query_id, group_doc, root: one row per query_id."""
    records = cut(record_vertices(gt_items))
    _, labels = spanning_forest(tie_edges(records))
    firsts = records.select("query_id", F.col("vertices")[0].alias("vertex"))
    rooted = salted_join(firsts, labels, ["vertex"], by=["query_id"], how="left").select("query_id", "vertex", F.coalesce("root", "vertex").alias("root"))
    names = (
        labels.select("vertex", "root")
        .unionByName(rooted.select("vertex", "root").distinct())
        .groupBy("root")
        .agg(F.min(F.when(F.col("vertex").startswith("d:"), F.substring("vertex", 3, 1 << 30))).alias("group_doc"))
    )
    named = salted_join(rooted, names, ["root"], by=["query_id"])
    return named.groupBy("query_id").agg(F.min("group_doc").alias("group_doc"), F.min("root").alias("root"))


def assign_splits(groups: DataFrame, proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """query_id, group_doc, split_name: whole groups dealt to splits within bands of like size.

    A band holds sizes up to twice the smallest, so there are no more bands than the logarithm of the largest group. What
    comes to the driver are the records of each band and split.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    banded = sizes.withColumn("band", F.floor(F.log2("size")).cast("int"))
    placed = cut(running_counts(banded, ["band"], [F.xxhash64("root"), F.col("root")], "size", "before"))
    totals = {r.band: r.total for r in placed.groupBy("band").agg(F.sum("size").alias("total")).collect()}
    whole, records = sum(proportions.values()), sum(totals.values())
    lacking = {name: share / whole * records for name, share in proportions.items()}
    dealt = F.lit(None).cast("string")
    for band in sorted(totals, reverse=True):
        open_ = {name: max(0.0, x) for name, x in lacking.items()}
        upto, bounds = 0.0, []
        for name, x in open_.items():
            upto += x / sum(open_.values()) * totals[band]
            bounds.append((name, upto))
        name = F.lit(bounds[-1][0])
        for n, bound in reversed(bounds[:-1]):
            name = F.when(F.col("before") + F.col("size") / 2 < bound, n).otherwise(name)
        for r in placed.where(F.col("band") == band).groupBy(name.alias("name")).agg(F.sum("size").alias("got")).collect():
            lacking[r.name] -= r.got
        dealt = F.when(F.col("band") == band, name).otherwise(dealt)
    return salted_join(groups, placed.select("root", dealt.alias("split_name")), ["root"], by=["query_id"]).select("query_id", "group_doc", "split_name")


def split_report(assigned: DataFrame) -> DataFrame:
    """split_name, n_records, n_groups, share."""
    by = assigned.groupBy("split_name").agg(F.count("*").alias("n_records"), F.count_distinct("group_doc").alias("n_groups"))
    # three splits, so this window holds three rows
    total = F.sum("n_records").over(Window.partitionBy(F.lit(1)))
    return by.select("split_name", "n_records", "n_groups", F.round(F.col("n_records") / total, 4).alias("share"))
