"""Validation and bookkeeping of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legistra.functions.ids import canonical_doc, canonical_node, gold_doc
from legistra.operators.corpus_tables import current_nodes, newest
from legistra.operators.scale import running_counts

TYPES = ("factual", "paraphrased", "multihop")
MODES = ("none", "legal_ref", "doc_only", "both")


def gt_errors(gt_items: DataFrame, current: DataFrame) -> DataFrame:
    """query_id, error: one row per rule that a ground-truth record breaks."""
    doc = gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids"))
    node = canonical_node(F.col("gold_anchor_node_id"))
    known = current.select(canonical_doc(F.col("doc_id")).alias("d"), canonical_node(F.col("node_id")).alias("a"), F.col("granularity").alias("g")).distinct().withColumn("known", F.lit(True))
    items = gt_items.select("*", doc.alias("d"), node.alias("a"), F.col("gold_anchor_granularity").alias("g")).join(known, ["d", "a", "g"], "left")
    arity = F.coalesce(F.size("gold_anchor_node_ids"), F.lit(0))
    rules = {
        "short_query": F.length(F.trim(F.coalesce("query", F.lit("")))) < 10,
        "bad_type": ~F.coalesce(F.col("query_type").isin(*TYPES), F.lit(False)),
        "bad_mode": ~F.coalesce(F.col("reference_mode").isin(*MODES), F.lit(False)),
        "no_document": F.col("d").isNull(),
        "no_anchor": F.col("a").isNull(),
        "anchor_unknown": F.col("a").isNotNull() & F.col("known").isNull(),
        "anchor_arity": arity != F.when(F.col("query_type") == "multihop", 2).otherwise(1),
    }
    each = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return items.select("query_id", F.explode(each).alias("error")).distinct()


def collected(gt_items: DataFrame) -> DataFrame:
    """seq_id, query_id of the records that stay: the first of the same question, then of the same document, anchor and type.

    Numbered in the order of their ids; texts are compared without case and outer blanks.
    """
    base = newest(gt_items.where("query_id is not null"), ["query_id"], ["created_at"])
    text = F.lower(F.trim(F.coalesce("query", F.lit(""))))
    one = base.withColumn("t", text).groupBy("t").agg(F.min("query_id").alias("query_id"))
    kept = base.join(one.select("query_id"), "query_id", "left_semi")
    key = kept.select("query_id", F.coalesce(gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")), F.lit("")).alias("d"), F.coalesce(canonical_node(F.col("gold_anchor_node_id")), F.lit("")).alias("a"), F.coalesce("query_type", F.lit("")).alias("y"))
    two = key.groupBy("d", "a", "y").agg(F.min("query_id").alias("query_id"))
    counted = two.select("query_id", F.lit(1).alias("one"), F.lit("all").alias("all"))
    numbered = running_counts(counted, ["all"], [F.col("query_id")], "one", "before")
    return numbered.select(F.format_string("q%03d", F.col("before") + 1).alias("seq_id"), "query_id")


def quality_scores(nodes: DataFrame) -> DataFrame:
    """doc_id, n_articles, score, verdict of a document's articles (granularity pasal).

    100 times the share of the expected articles, less 15 if their numbers fall in reading order, 2 for every number that is absent
    between the least and the largest (15 at most), 5 for every leaf whose text holds another article's heading (20 at most), 8
    for every leaf that says next to nothing (25 at most), and 1 for every leaf that should have been split (10 at most).
    Expected are the articles that the loads of the document ever had.
    """
    rows = nodes.where("granularity = 'pasal' and doc_id is not null and node_id is not null")
    expected = rows.where(F.col("node_id").rlike("^pasal_[0-9]+")).groupBy("doc_id").agg(F.count_distinct("node_id").alias("expected"))
    number = F.nullif(F.regexp_extract("node_id", r"^pasal_([0-9]+)", 1), F.lit("")).cast("int")
    text, title = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    marks = lambda pattern: F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))))
    cur = current_nodes(rows).withColumn("num", number)
    w = Window.partitionBy("doc_id").orderBy("ord_path", "node_id")
    marked = cur.withColumn("falls", F.col("num") < F.lag("num").over(w)).withColumns({
        "empty": F.col("is_leaf") & title.rlike(r"^Pasal\s+\d") & ((F.length(text) < 30) | (text == title)),
        "bleeds": F.col("is_leaf") & F.coalesce(F.col("text").rlike(r"(?m)\n\s*Pasal\s+\d+[A-Z]?\s*$"), F.lit(False)),
        "unsplit": F.col("is_leaf") & ((marks(r"(?m)^\((\d+)\)\s") >= 2) | (marks(r"(?m)^([a-z])\.\s") >= 3) | (marks(r"(?m)^(\d+)\.\s") >= 3)),
    })
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0))
    g = marked.groupBy("doc_id").agg(
        F.count_distinct("node_id").alias("actual"), F.count_distinct("num").alias("n_articles"), (F.max("num") - F.min("num") + 1).alias("span"),
        n("falls").alias("falls"), n("empty").alias("empty"), n("bleeds").alias("bleeds"), n("unsplit").alias("unsplit"),
    ).join(expected, "doc_id", "left")
    complete = F.least(F.lit(1.0), F.coalesce(F.col("actual") / F.col("expected"), F.lit(1.0)))
    gaps = F.coalesce(F.col("span") - F.col("n_articles"), F.lit(0))
    points = 100.0 * complete - F.when(F.col("falls") > 0, 15).otherwise(0) - F.least(F.lit(15), 2 * gaps) - F.least(F.lit(20), 5 * F.col("bleeds"))
    score = F.greatest(F.lit(0.0), F.round(points - F.least(F.lit(25), 8 * F.col("empty")) - F.least(F.lit(10), F.col("unsplit")), 1))
    return g.select("doc_id", "n_articles", score.alias("score"), F.when(score >= 90, "OK").when(score >= 70, "PARTIAL").otherwise("FAIL").alias("verdict"))


def eligibility(registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, decision: keep, drop, or orphan for what is neither listed with a PDF nor indexed."""
    reg = newest(registry.where("doc_id is not null"), ["doc_id"], ["scraped_at", "scrape_id"]).select("doc_id", "has_pdf", "removed_at")
    verdicts = quality_scores(nodes).select("doc_id", "verdict")
    both = reg.join(verdicts, "doc_id", "full_outer")
    decision = (
        F.when(F.col("verdict").isin("OK", "PARTIAL") & F.col("removed_at").isNull(), "keep")
        .when(F.col("verdict").isNotNull(), "drop")
        .when(~F.coalesce("has_pdf", F.lit(False)), "orphan")
        .otherwise("pending")
    )
    return both.select("doc_id", decision.alias("decision"))


def stale(registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, state: fresh if its newest load is not older than its newest scrape, stale if older, missing if there is none."""
    r = registry.where("doc_id is not null").groupBy("doc_id").agg(F.max("scraped_at").alias("scraped"))
    n = nodes.groupBy("doc_id").agg(F.max("loaded_at").alias("loaded"))
    state = F.when(F.col("loaded").isNull(), "missing").when(F.col("loaded") >= F.col("scraped"), "fresh").otherwise("stale")
    return r.join(n, "doc_id", "left").select("doc_id", state.alias("state"))


def to_resume(gt_items: DataFrame, runs: DataFrame, system: str) -> DataFrame:
    """query_id of the questions that a system has not answered yet; runs that ended with an error count as done."""
    done = runs.where((F.col("system") == system) & F.col("logged_at").isNotNull()).select("query_id")
    return gt_items.where("query_id is not null").select("query_id").distinct().join(done, "query_id", "left_anti")


def mirror_actions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, action: what to push (only in left) and what to delete (only in right)."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("action", F.lit("push")).unionByName(b.join(a, key, "left_anti").withColumn("action", F.lit("delete")))
