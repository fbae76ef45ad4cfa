"""Splitting provisions into clauses, letters and numbers, and checking parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# scanner's errors in headings, as (pattern, replacement), in this order.
HEADING_FIXES = (
    (r"\bPasal(\d)", "Pasal $1"),
    (r"(?m)^Pasal\s+(\d)\s+(\d{1,2})\s*$", "Pasal $1$2"),
    (r"\bPasal\s+(\d{1,3})O\b", "Pasal ${1}0"),
    (r"\bPasal\s+(\d{1,3})l\b", "Pasal ${1}1"),
    (r"\bPasa[T1I](\s+\d)", "Pasal$1"),
    (r"(?m)^(\s*\d+)O(\.\s)", "${1}0$2"),
    (r"(?m)^(\s*\d+)l(\.\s)", "${1}1$2"),
)


def deep_split(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, ayat, huruf, n_lines, text_md5: the lines under each clause (1) and, inside it, each letter a.

    Lines before the first clause have ayat ''; those of a clause before its first letter have huruf ''.
    """
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ayat = F.nullif(F.regexp_extract("line", r"^\(([0-9]+)\) ", 1), F.lit(""))
    huruf = F.nullif(F.regexp_extract("line", r"^([a-z])\. ", 1), F.lit(""))
    marked = lines.withColumn("a", ayat).withColumn("h", huruf).withColumn("part", F.sum(F.col("a").isNotNull().cast("int")).over(w))
    inner = Window.partitionBy(key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    labelled = marked.withColumn("ayat", F.coalesce(F.last("a", ignorenulls=True).over(inner), F.lit(""))).withColumn("huruf", F.coalesce(F.last("h", ignorenulls=True).over(inner), F.lit("")))
    grouped = labelled.groupBy(key, "part", "ayat", "huruf").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return grouped.select(key, F.col("part").cast("bigint").alias("part"), "ayat", "huruf", F.size("ls").cast("bigint").alias("n_lines"), F.md5(body).alias("text_md5"))


def fixed_heading(line: Column) -> Column:
    """A text with the scanner's common errors in article headings and item numbers mended."""
    out = line
    for pattern, replacement in HEADING_FIXES:
        out = F.regexp_replace(out, pattern, replacement.replace("${1}", "$1"))
    return out


def document_checks(current: DataFrame) -> DataFrame:
    """doc_id, granularity, n_articles, n_missing, n_empty, monotonic, verdict of every parsed document.

    Articles are counted by the number in `pasal_N`; missing ones lie between the least and the largest. FAIL if none are
    there, WARN if numbers are missing, leaves are empty or the reading order is not that of the numbers.
    """
    number = F.regexp_extract("node_id", r"^pasal_([0-9]+)", 1)
    rows = current.select("granularity", "doc_id", "ord_path", "node_id", F.nullif(number, F.lit("")).cast("int").alias("n"), "is_leaf", "text")
    w = Window.partitionBy("granularity", "doc_id").orderBy("ord_path", "node_id")
    marked = rows.withColumn("falls", (F.col("n") < F.lag("n").over(w)).cast("int"))
    g = marked.groupBy("granularity", "doc_id").agg(
        F.count_distinct("n").alias("n_articles"), (F.max("n") - F.min("n") + 1).alias("span"), F.coalesce(F.sum("falls"), F.lit(0)).alias("falls"),
        F.sum((F.col("is_leaf") & (F.coalesce(F.trim("text"), F.lit("")) == "")).cast("bigint")).alias("n_empty"),
    )
    missing = F.greatest(F.coalesce(F.col("span") - F.col("n_articles"), F.lit(0)), F.lit(0)).cast("bigint")
    verdict = F.when(F.col("n_articles") == 0, "FAIL").when((missing > 0) | (F.coalesce("n_empty", F.lit(0)) > 0) | (F.col("falls") > 0), "WARN").otherwise("OK")
    return g.select("granularity", "doc_id", "n_articles", missing.alias("n_missing"), F.coalesce("n_empty", F.lit(0)).alias("n_empty"), (F.col("falls") == 0).alias("monotonic"), verdict.alias("verdict"))


def page_ends(current: DataFrame) -> DataFrame:
    """granularity, doc_id, node_id, start_index, derived_end: the page before the next sibling's first, at least its own."""
    w = Window.partitionBy("granularity", "doc_id", F.coalesce("parent_id", F.lit(""))).orderBy("ord_path", "node_id")
    after = F.lead("start_index").over(w)
    end = F.when(after.isNull(), F.col("end_index")).otherwise(F.greatest(F.col("start_index"), after - 1))
    return current.select("granularity", "doc_id", "node_id", "start_index", end.alias("derived_end"))


def proportional_quotas(parts: DataFrame, group: str, part: str, size: str, total: int) -> DataFrame:
    """group, part, quota: one for each part and the rest in proportion to size, floors first, then the largest remainders.

    Equal remainders go to the later part. Groups with more parts than total get one each for their first ones.
    """
    w = Window.partitionBy(group)
    base = parts.select(group, part, F.col(size).alias("__s")).withColumn("n", F.count("*").over(w)).withColumn("sum", F.sum("__s").over(w))
    left = F.greatest(F.lit(total) - F.col("n"), F.lit(0))
    shared = base.withColumn("x", F.round(F.when(F.col("sum") > 0, left * F.col("__s") / F.col("sum")).otherwise(0.0), 9)).withColumn("f", F.floor("x")).withColumn("left", left)
    order = Window.partitionBy(group).orderBy((F.col("x") - F.col("f")).desc(), F.col(part).desc())
    first = Window.partitionBy(group).orderBy(part)
    placed = shared.withColumn("place", F.row_number().over(order)).withColumn("gone", F.sum("f").over(w)).withColumn("i", F.row_number().over(first))
    quota = F.when(F.col("i") <= total, 1).otherwise(0) + F.col("f") + F.when(F.col("place") <= F.col("left") - F.col("gone"), 1).otherwise(0)
    return placed.select(group, part, quota.cast("bigint").alias("quota"))


def review_states(nodes: DataFrame, gt_items: DataFrame, splits: DataFrame) -> DataFrame:
    """doc_id, state of every document: `applied` if its questions are split, `annotated` if it has questions, `built` if indexed."""
    from legistra.functions.ids import canonical_doc, gold_doc

    asked = gt_items.select("query_id", gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")).alias("doc_id")).where("doc_id is not null")
    split = asked.join(splits.where("query_id is not null").select("query_id").distinct(), "query_id", "left_semi").select("doc_id").distinct().withColumn("s", F.lit(1))
    docs = nodes.select(canonical_doc(F.col("doc_id")).alias("doc_id")).where("doc_id is not null").distinct().withColumn("b", F.lit(1))
    both = docs.join(asked.select("doc_id").distinct().withColumn("a", F.lit(1)), "doc_id", "full_outer").join(split, "doc_id", "left")
    state = F.when(F.col("b").isNull(), "not-built").when(F.col("s") == 1, "applied").when(F.col("a") == 1, "annotated").otherwise("built")
    return both.select("doc_id", state.alias("state"))


def repeated_actions(runs: DataFrame) -> DataFrame:
    """run_id, hint of runs that do the same as one of the two before them: same system, question and granularity."""
    w = Window.partitionBy("system", "query_id").orderBy("started_at", "run_id")
    same = [F.lag("eval_granularity", k).over(w) for k in (1, 2)]
    marked = runs.where("query_id is not null").select("run_id", "system", "query_id", "eval_granularity", "started_at", same[0].alias("b1"), same[1].alias("b2"))
    one, two = F.coalesce(F.col("b1") == F.col("eval_granularity"), F.lit(False)), F.coalesce(F.col("b2") == F.col("eval_granularity"), F.lit(False))
    return marked.where(one | two).select("run_id", F.when(one & two, "stop").otherwise("vary").alias("hint"))
