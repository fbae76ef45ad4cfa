"""Splitting texts at numbered clauses, letters and items, level by level, and putting parsed parts together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.parsing import CLOSING
from legistra.session import cut

# Words at a line's end after which a mark is a reference, and how the kinds of marks are written.
REFERENCE_WORDS = ("ayat", "pasal", "huruf", "angka", "pada", "di", "dalam")
MARKS = {"ayat": r"^\s*\(([0-9]+)\)(?:\s|$)", "huruf": r"^\s*([a-z])\.\s", "angka": r"^\s*([0-9]+)\.\s"}
TITLES = {"ayat": ("Ayat (", ")"), "huruf": ("Huruf ", ""), "angka": ("Angka ", "")}


def _index(kind: str, label: Column) -> Column:
    return F.ascii(label) - 96 if kind == "huruf" else label.try_cast("int")


def valid_marks(rows: DataFrame, key: list[str], text: str, kind: str) -> DataFrame:
    """key, line_no, label: the marks of a kind that make a run 1, 2, 3 or a, b, c of at least two in a text.

    A mark after a line that ends in a reference word is none. Of two equal marks that follow each other the later counts.
    A text whose marks don't make such a run has none.
    """
    lines = rows.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    by = Window.partitionBy(*key).orderBy("pos")
    before = F.lower(F.regexp_extract(F.trim(F.coalesce(F.lag("line").over(by), F.lit(""))), r"(\S+)$", 1))
    found = lines.withColumn("before", before).withColumn("label", F.regexp_extract("line", MARKS[kind], 1)).where(F.col("label") != "")
    found = found.where(~F.col("before").isin(*REFERENCE_WORDS)).select(*key, "pos", "label")
    once = found.withColumn("next", F.lead("label").over(by)).where("next is null or next <> label")
    whole = Window.partitionBy(*key)
    numbered = once.withColumn("i", F.row_number().over(by)).withColumn("fits", (_index(kind, F.col("label")) == F.col("i")).cast("int"))
    kept = numbered.withColumn("n", F.count("*").over(whole)).withColumn("all", F.min("fits").over(whole)).where("n >= 2 and all = 1")
    return kept.select(*key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "label")


def split_level(rows: DataFrame, kind: str) -> DataFrame:
    """root, node_id, title, parent_id, label, body: texts split at the valid marks of a kind; others stay as they are.

    rows: root, node_id, title, parent_id, body. Of a text that is split, each clause is a child whose id and title go on
    from the parent's; the part before the first mark stays with the parent. Clauses without a text are left out.
    """
    key = ["root", "node_id"]
    marks = valid_marks(rows, key, "body", kind)
    lines = rows.select(*key, "title", "parent_id", F.posexplode(F.split("body", "\n")).alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("bigint"))
    marked = lines.join(marks, [*key, "line_no"], "left")
    by = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    part = marked.withColumn("part", F.count("label").over(by)).withColumn("line", F.when(F.col("label").isNotNull(), F.regexp_replace("line", MARKS[kind], "")).otherwise(F.col("line")))
    each = part.groupBy(*key, "part").agg(F.max("title").alias("title"), F.max("parent_id").alias("parent_id"), F.max("label").alias("label"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    text = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    opens, closes = TITLES[kind]
    child = F.col("label").isNotNull()
    out = each.withColumn("text", text).where("text <> ''")
    return out.select(
        "root", F.when(child, F.concat_ws("_", "node_id", F.lit(kind), "label")).otherwise(F.col("node_id")).alias("node_id"),
        F.when(child, F.concat(F.coalesce("title", F.lit("")), F.lit(" " + opens), F.col("label"), F.lit(closes))).otherwise(F.col("title")).alias("title"),
        F.when(child, F.col("node_id")).otherwise(F.col("parent_id")).alias("parent_id"), F.col("text").alias("body"),
    )


def deep_nodes(leaves: DataFrame) -> DataFrame:
    """load_id, node_id, title, parent_id, text_md5: leaves split into clauses, those into letters, and those into items."""
    rows = leaves.select(F.col("load_id").alias("root"), "node_id", "title", F.lit("").alias("parent_id"), F.col("text").alias("body"))
    for kind in ("ayat", "huruf", "angka"):
        rows = split_level(rows, kind)
    return rows.select(F.col("root").alias("load_id"), "node_id", "title", "parent_id", F.md5("body").alias("text_md5"))


def merged_chunks(parts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key, n_copies, text_md5: what several parses of the same place gave; the longest text stays, of equal ones the first in order."""
    best = F.min_by("text", F.struct(-F.length("text"), *order))
    kept = parts.where("text is not null")
    return kept.groupBy(*key).agg(F.count("*").alias("n_copies"), best.alias("t")).select(*key, "n_copies", F.md5("t").alias("text_md5"))


def normalised_leaf(text: Column) -> Column:
    """A leaf's text up to the closing of the document, without headings that spilled over at its end, blank lines as one."""
    out = F.regexp_replace(text, rf"(?s)(?:{CLOSING}).*$", "")
    out = F.regexp_replace(out, r"(?:\n\s*(?:BAB\s+[IVXLC]+|Bagian\s+\w+|Paragraf\s+\d+)[^\n]*)+\s*$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def column_order(blocks: DataFrame, page: list[str], width: int = 600) -> DataFrame:
    """page, place, text: blocks (x0, x1, y0, text) in reading order: the left column before the right one where a page has two.

    It has two if it has four blocks or more, three or more on each side, and fewer than three in ten wide ones, over 0.6
    of the page.
    """
    by = Window.partitionBy(*page)
    left = F.col("x0") < width / 2
    wide = (F.col("x1") - F.col("x0")) > 0.6 * width
    n = lambda c: F.sum(c.cast("int")).over(by)
    counted = blocks.withColumns({"n": F.count("*").over(by), "l": n(left & ~wide), "r": n(~left & ~wide), "w": n(wide)})
    two = (F.col("n") >= 4) & (F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("w") < 0.3 * F.col("n"))
    side = F.when(two, F.when(left, 0).otherwise(1)).otherwise(0)
    place = F.row_number().over(by.orderBy("side", "y0", "x0", "text"))
    return counted.withColumn("side", side).select(*page, place.alias("place"), "text")


def first_sentence(text: Column) -> Column:
    """The stand-in for a summarising model: a text's first sentence."""
    return F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"^\s*([^.;]*)", 1)


def bottom_up(nodes: DataFrame, summarise: Callable[[Column], Column] = first_sentence, cap: int = 4000) -> DataFrame:
    """doc_id, node_id, summary: leaves summed up from their texts, up to cap characters, other nodes from their children's titles and summaries.

    nodes: doc_id, node_id, parent_id, ord_path, depth, title, text, summary. Summaries that are there stay. The
    levels are worked through from the deepest up, one pass each; what the model reads of a leaf is cut, as it always was.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    rows = nodes.select("doc_id", "node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "ord_path", "depth", "title", F.nullif(F.trim("summary"), F.lit("")).alias("own"), "text")
    done: DataFrame | None = None
    out: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        level = rows.where(F.col("depth") == depth)
        told = F.substring(F.coalesce("text", F.lit("")), 1, cap)
        if done is not None:
            line = F.concat_ws(": ", F.coalesce("title", F.lit("")), "summary")
            below = done.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord_path", "node_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("below"))
            level, told = level.join(below, ["doc_id", "node_id"], "left"), F.coalesce(F.col("below"), told)
        done = cut(level.select("doc_id", "node_id", "parent_id", "ord_path", "title", F.coalesce("own", summarise(told)).alias("summary")))
        one = done.select("doc_id", "node_id", "summary")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else nodes.select("doc_id", "node_id", "summary").limit(0)
