"""The corpus as it stands: the newest alive load of every node, leaves, and how nodes hang together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("granularity", "doc_id", "node_id")
NO_EXPLANATION = "Cukup jelas."


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`, compared as a tuple: an upsert where the newest wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__m")).select(*keys, "__m.__row.*")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The newest load of every node, without those that were deleted. Nodes without a key part are left out."""
    keyed = nodes.where("granularity is not null and doc_id is not null and node_id is not null")
    return newest(keyed, list(KEY), ["loaded_at", "load_id"]).where("deleted_at is null")


def enriched(title: Column, navigation_path: Column, text: Column, penjelasan: Column) -> Column:
    """The text that a leaf is searched by: title, path, text, and the elucidation unless it says nothing."""
    base = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(navigation_path, F.lit("")), F.coalesce(text, F.lit("")))
    told = F.coalesce((penjelasan != "") & (penjelasan != NO_EXPLANATION), F.lit(False))
    return F.when(told, F.concat_ws(" ", base, penjelasan)).otherwise(base)


def leaves(current: DataFrame, granularity: str | None = None) -> DataFrame:
    """Leaf nodes with text, with `search_text`."""
    found = current.where("is_leaf and text is not null and text <> ''")
    if granularity is not None:
        found = found.where(F.col("granularity") == granularity)
    return found.withColumn("search_text", enriched(F.col("title"), F.col("navigation_path"), F.col("text"), F.col("penjelasan")))


def parent_prefix(node_id: Column) -> Column:
    """The id without its last label and value; '' for one of fewer than four parts."""
    parts = F.split(node_id, "_")
    return F.when(F.size(parts) < 4, "").otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "_"))


def canonical_title(node_id: Column) -> Column:
    """A title from the deepest `pasal` of an id onward: `Pasal 3 Ayat (2) Huruf a`."""
    tail = F.regexp_extract(node_id, r"(pasal_[0-9A-Za-z]+(?:_(?:ayat|huruf|angka)_[0-9A-Za-z]+)*)$", 1)
    s = F.regexp_replace(tail, r"pasal_([0-9]+[A-Za-z]?)", "Pasal $1")
    s = F.regexp_replace(s, r"_ayat_([0-9A-Za-z]+)", " Ayat ($1)")
    s = F.regexp_replace(s, r"_huruf_([0-9A-Za-z]+)", " Huruf $1")
    return F.regexp_replace(s, r"_angka_([0-9A-Za-z]+)", " Angka $1")


def preorder(current: DataFrame) -> DataFrame:
    """Every node with its position in its document's pre-order, from 1."""
    w = Window.partitionBy("granularity", "doc_id").orderBy("ord_path", "node_id")
    return current.select(*KEY, "ord_path", "depth", F.row_number().over(w).alias("position"))


def navigation_check(current: DataFrame) -> DataFrame:
    """Nodes whose stored path doesn't end in their title: granularity, doc_id, node_id, stored, expected_end."""
    last = F.element_at(F.split("navigation_path", " > "), -1)
    return current.where(F.coalesce(last != F.col("title"), F.lit(True))).select(*KEY, F.col("navigation_path").alias("stored"), F.col("title").alias("expected_end"))


def page_bounds_broken(current: DataFrame) -> DataFrame:
    """Nodes whose pages run backwards."""
    return current.where("start_index > end_index").select(*KEY, "start_index", "end_index")


def duplicate_loads(nodes: DataFrame) -> DataFrame:
    """Per document and granularity how many rows, keys and surplus rows it has."""
    return nodes.groupBy("granularity", "doc_id").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("node_id").alias("n_nodes"),
        (F.count("*") - F.count_distinct("node_id")).alias("n_surplus"),
    )


def leaf_counts(current: DataFrame) -> DataFrame:
    """Leaves per document and granularity, one column each."""
    return (
        current.where("is_leaf").groupBy("doc_id").pivot("granularity", ["pasal", "ayat", "rincian"]).count()
        .select("doc_id", *[F.coalesce(g, F.lit(0)).alias(g) for g in ("pasal", "ayat", "rincian")])
    )


def granularity_suspects(current: DataFrame) -> DataFrame:
    """Documents whose leaf counts don't rise from pasal to ayat to rincian, where a granularity is present."""
    bad = "(pasal > ayat and ayat > 0) or (ayat > rincian and rincian > 0)"
    return leaf_counts(current).where(bad)


def leaf_lengths(current: DataFrame) -> DataFrame:
    """Lengths of leaf texts per granularity: number, mean, median, p95, p99, longest, shares over 5,000 and 10,000 characters.

    The percentiles are values as they stand, at place floor(n * q) from 0. Lengths are counted first, so what is ordered are
    distinct lengths.
    """
    counted = leaves(current).groupBy("granularity", F.length("text").alias("size")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("granularity").orderBy("size")
    placed = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("granularity")))
    at = lambda q: F.floor(F.col("n") * F.lit(q))
    holds = lambda q: (F.col("upto") > at(q)) & (F.col("upto") - F.col("c") <= at(q))
    over = lambda size: F.round(100 * F.sum(F.when(F.col("size") > size, F.col("c")).otherwise(0)) / F.sum("c"), 1)
    return placed.groupBy("granularity").agg(
        F.sum("c").alias("n"), F.round(F.sum(F.col("size") * F.col("c")) / F.sum("c")).cast("bigint").alias("mean_chars"),
        *[F.max(F.when(holds(q), F.col("size"))).cast("bigint").alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)],
        F.max("size").cast("bigint").alias("longest"), over(5000).alias("over_5000_percent"), over(10_000).alias("over_10000_percent"),
    )


def depth_and_branching(current: DataFrame) -> DataFrame:
    """Per granularity and depth: nodes, documents, and nodes a document has at that depth on average."""
    per_doc = current.groupBy("granularity", "doc_id", "depth").agg(F.count("*").alias("n"))
    return per_doc.groupBy("granularity", "depth").agg(
        F.sum("n").alias("n_nodes"), F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_branching"), F.max("n").alias("most")
    )


def rolled_up(current: DataFrame, granularity: str = "rincian") -> DataFrame:
    """Texts of the leaves of each article, joined in reading order: doc_id, pasal, n_leaves, n_chars, text_md5."""
    at = F.regexp_extract("node_id", r"^(.*?pasal_[0-9A-Za-z]+)", 1)
    rows = leaves(current, granularity).select("doc_id", at.alias("pasal"), F.struct("ord_path", "node_id", "text").alias("leaf")).where("pasal <> ''")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list("leaf")), lambda x: x["text"]), "\n")
    return rows.groupBy("doc_id", "pasal").agg(F.count("*").alias("n_leaves"), ordered.alias("text")).select(
        "doc_id", "pasal", "n_leaves", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def ancestors(current: DataFrame) -> DataFrame:
    """Every node with each of its ancestors in the corpus, by id prefix: doc_id, node_id, ancestor_id, distance."""
    parts = F.split("node_id", "_")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    each = current.select("granularity", "doc_id", "node_id", F.size(parts).alias("n"), F.posexplode(prefix).alias("pos", "ancestor_id"))
    known = current.select("granularity", "doc_id", F.col("node_id").alias("ancestor_id"))
    kept = each.where(F.col("ancestor_id") != F.col("node_id")).join(known, ["granularity", "doc_id", "ancestor_id"])
    return kept.select("granularity", "doc_id", "node_id", "ancestor_id", ((F.col("n") - F.col("pos") - 1) / 2).cast("int").alias("distance"))


def nearest_leaf(anchors: DataFrame, current: DataFrame, granularity: str) -> DataFrame:
    """For each anchor (doc_id, node_id) the nearest leaf of a granularity whose id is a prefix of it, or itself."""
    parts = F.split("node_id", "_")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    each = anchors.select("doc_id", "node_id").distinct().select("doc_id", "node_id", F.posexplode(prefix).alias("pos", "leaf_id"))
    known = leaves(current, granularity).select("doc_id", F.col("node_id").alias("leaf_id"))
    hit = each.join(known, ["doc_id", "leaf_id"])
    return hit.groupBy("doc_id", "node_id").agg(F.max_by("leaf_id", "pos").alias("leaf_id"))
