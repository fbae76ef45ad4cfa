"""Sources beside Parquet: JSON lines, Markdown tables, HTML lists, file names, and what to read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file that holds one JSON array of objects; unreadable records are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_lines(lines: DataFrame, schema: str, required: Sequence[str] = (), column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The records in JSON lines, and one row (n_lines, n_invalid). Blank lines don't count.

    A line is invalid if it isn't a JSON object or lacks a required field.
    """
    raw = lines.where(F.trim(F.col(column)) != "").select(F.trim(F.col(column)).alias("__l"))
    parsed = raw.select("__l", F.from_json("__l", schema).alias("__r"), F.try_parse_json("__l").isNotNull().alias("__ok"))
    good = F.col("__ok") & F.col("__l").startswith("{")
    for f in required:
        good = good & F.col(f"__r.{f}").isNotNull()
    marked = parsed.withColumn("__good", F.coalesce(good, F.lit(False)))
    counts = marked.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum((~F.col("__good")).cast("bigint")), F.lit(0)).alias("n_invalid"))
    return marked.where("__good").select("__r.*"), counts


def combo_of(stem: Column) -> tuple[Column, Column]:
    """The system and the rest of a file stem, parted at the first double underscore."""
    at = F.instr(stem, "__")
    return F.when(at > 0, F.substring(stem, F.lit(1), at - 1)).otherwise(stem), F.when(at > 0, F.substring(stem, at + 2, F.length(stem)))


def markdown_verdicts(lines: DataFrame, file: str, no: str, line: str, column: str = "layak") -> DataFrame:
    """file, verdict, n: verdicts in the Markdown tables that have a column of that name, summed per file.

    Verdicts beginning with `tidak` count as TIDAK, with `layak` or `ya` as LAYAK, others as unknown; marks around them
    don't count. A table ends at the first line that doesn't begin with a bar.
    """
    w = Window.partitionBy(file).orderBy(no)
    cells = F.transform(F.split(F.regexp_replace(F.trim(F.col(line)), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(file, no, F.trim(F.col(line)).startswith("|").alias("bar"), cells.alias("cells"))
    rows = rows.withColumn("table", F.sum((~F.col("bar")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.array_position(F.transform("cells", lambda c: F.contains(F.lower(c), F.lit(column)).cast("int")), F.lit(1))
    in_table = Window.partitionBy(file, "table").orderBy(no)
    # the first row with such a cell is the header; those after it are the verdicts
    headed = rows.where("bar").withColumn("p", F.when(place > 0, place)).withColumn("at", F.first("p", ignorenulls=True).over(in_table.rowsBetween(Window.unboundedPreceding, -1)))
    body = headed.where(F.col("at").isNotNull() & ~F.forall("cells", lambda c: c.rlike("^:?-*:?$")))
    said = F.lower(F.regexp_replace(F.try_element_at("cells", F.col("at").cast("int")), r"[*_`\"'\s]", ""))
    verdict = F.when(said.startswith("tidak"), "TIDAK").when(said.startswith("layak") | said.startswith("ya"), "LAYAK").otherwise("unknown")
    return body.groupBy(file, verdict.alias("verdict")).agg(F.count("*").alias("n"))


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, href, label: the anchors of a page; the first of the same address stays."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\b[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>'), F.lit(0))
    each = pages.select(key, F.posexplode(found).alias("pos", "a"))
    href = F.regexp_extract("a", r'(?is)href\s*=\s*"([^"]*)"', 1)
    label = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?is)<[^>]+>", " "), r"\s+", " "))
    return each.select(key, "pos", href.alias("href"), label.alias("label")).groupBy(key, "href").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))


def detail_cards(links: DataFrame, key: str) -> DataFrame:
    """key, detail_id, slug of links to detail pages; others, and those without an id and a slug, are left out."""
    parts = F.regexp_extract("href", r"/Details/([0-9]+)/([^/?#]+)", 1), F.regexp_extract("href", r"/Details/([0-9]+)/([^/?#]+)", 2)
    return links.select(key, parts[0].alias("detail_id"), parts[1].alias("slug")).where("detail_id <> '' and slug <> ''")


def metadata_key(c: Column) -> Column:
    """A field name in lower case, without dots, with underscores for blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.", ""), r"\s+", "_")


def best_pdf(files: DataFrame, doc: str, name: str) -> DataFrame:
    """doc, name: the shortest PDF name of each document that is no annex."""
    kept = files.where(F.lower(F.col(name)).endswith(".pdf") & ~F.contains(F.lower(F.col(name)), F.lit("lampiran")))
    return kept.groupBy(doc).agg(F.min_by(name, F.struct(F.length(name), F.col(name))).alias(name))


def page_range(text: str, total: int) -> list[int]:
    """The pages that `all`, `a-b` or `n` names, within 1 to total."""
    s = text.strip().lower()
    if s in ("", "all"):
        return list(range(1, total + 1))
    m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", s)
    if not m:
        raise ValueError(f"no page range: {text}")
    first = int(m.group(1))
    return [p for p in range(first, int(m.group(2) or first) + 1) if 1 <= p <= total]


def clean_label(text: str) -> str:
    """A label fit for a folder name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-")


def longest_prefix(docs: DataFrame, doc: str, categories: DataFrame) -> DataFrame:
    """doc, folder: the category whose prefix followed by a dash begins the id; the longest counts, null if none.

    categories: prefix, folder; a fixed list of some tens of rows.
    """
    pairs = docs.select(doc).distinct().join(categories, F.col(doc).startswith(F.concat("prefix", F.lit("-"))), "left")
    return pairs.groupBy(doc).agg(F.max_by("folder", F.length("prefix")).alias("folder"))
