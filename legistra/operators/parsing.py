"""From page texts to trees: cleaning, page roles, chunks, ids, paths, elucidations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legistra.session import cut, persist_table

# What is taken out of page texts, or put right in them, as (pattern, replacement), in this order.
PAGE_FIXES = (
    (r"(?m)^\s*(?:FRESIDEN|PRESIDEN|PNESIDEN|PRESTDEN|PTTESIDEN)\s*$", ""),
    (r"(?m)^\s*(?:REFUBUK|REPUEUK|REPUBUK|REPUBLIK|NEPUBUK)\s+(?:TNDONESIA|INDONESIA|INDONESI,A)\s*$", ""),
    (r"(?m)^\s*(?:EUK|ELIK|BUK)\s+INDONESIA\s*$", ""),
    (r"\n\s*-\s*[t]?\d+\s*-?\s*\n", "\n"),
    (r"(?m)SK\s+No\s*\d+\s*A.*$", ""),
    (r"([^\s])(Pasal\s+\d)", "$1\n$2"),
    (r"(?m)^(Pasal)(\d)", "$1 $2"),
    (r"([^\n])(BAB\s+[IVXLCDM])", "$1\n$2"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)
# Misread digits of clauses and list items, in this order.
DIGIT_FIXES = (
    (r"\((\d+)[t]\b", "($1)"),
    (r"\(s\)", "(5)"),
    (r"(?m)^Pasa[lr]\s*\d+\s*\.{2,}\s*$", ""),
    (r"(?m)\.\s*\.\s*\.\s*$", ""),
)
CLOSING = r"Di(sahkan|tetapkan) di Jakarta|Agar setiap orang mengetahuinya"
ELUCIDATION_PAGE = r"PENJ\S*SAN\s*\n\s*ATAS"
AMENDMENT = r"(?i)PERUBAHAN|YESUAIAN|ATAS\s+UNDANG|ATAS\s+PERATURAN"
ARTICLE_HEADING = r"(?m)^\s*[Pp]asa[l1]\s+\d+[A-Z]?\b"
NOTHING_TO_SAY = "Cukup jelas."
STRUCTURAL = ("ayat", "pasal", "huruf", "angka", "dan", "atau", "sampai")
WHOLE_CHARS, WHOLE_ARTICLES, PAGES, OVERLAP = 120_000, 35, 10, 4
FIRSTS = 256  # beginnings of titles that pages are searched for, at most


def cleaned_page(text: Column) -> Column:
    """A page's text without running headers, page numbers and stamps, headings on lines of their own, digits put right."""
    out = text
    for pattern, replacement in PAGE_FIXES + DIGIT_FIXES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def pages_of(nodes: DataFrame) -> DataFrame:
    """doc_id, page_num, raw_text: texts with a page, joined in reading order, a line between them."""
    rows = nodes.where("doc_id is not null and text is not null and start_index is not null")
    each = rows.groupBy("doc_id", F.col("start_index").alias("page_num")).agg(F.sort_array(F.collect_list(F.struct("ord_path", "load_id", "text"))).alias("t"))
    return each.select("doc_id", "page_num", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("raw_text"))


def page_roles(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, closing_page, elucidation_page, body_end: the body ends before the first page of either kind."""
    first = lambda pattern: F.min(F.when(F.col("raw_text").rlike(pattern), F.col("page_num")))
    g = pages.groupBy("doc_id").agg(F.max("page_num").alias("n_pages"), first(CLOSING).alias("closing_page"), first(ELUCIDATION_PAGE).alias("elucidation_page"))
    end = F.least(F.col("elucidation_page") - 1, F.col("closing_page"))
    return g.withColumn("body_end", F.greatest(F.coalesce(end, F.col("n_pages")), F.lit(1)))


def amendments(registry: DataFrame) -> DataFrame:
    """scrape_id, is_amendment: whether a title says that the regulation changes another."""
    return registry.select("scrape_id", F.coalesce(F.col("judul").rlike(AMENDMENT), F.lit(False)).alias("is_amendment"))


def formatted_pages(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_chars, text_md5: all pages in one text, each under a line with its number."""
    line = F.concat(F.lit("=== PAGE "), F.col("page_num").cast("string"), F.lit(" ===\n"), F.col("raw_text"))
    each = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", line.alias("t")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n")
    return each.select("doc_id", F.size("p").cast("bigint").alias("n_pages"), F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


def article_chunks(pages: DataFrame, per_chunk: int = 20, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_no, first_page, last_page: so many article headings a chunk, cut between articles, with pages of overlap.

    Documents with fewer than two headings have none.
    """
    total = pages.groupBy("doc_id").agg(F.max("page_num").alias("total"))
    heads = pages.select("doc_id", "page_num", F.posexplode(F.regexp_extract_all("raw_text", F.lit(ARTICLE_HEADING), F.lit(0))).alias("pos", "h"))
    w = Window.partitionBy("doc_id").orderBy("page_num", "pos")
    counted = heads.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 2")
    firsts = counted.where(F.col("i") % per_chunk == 0).withColumn("chunk", F.floor(F.col("i") / per_chunk))
    after = F.lead("page_num").over(Window.partitionBy("doc_id").orderBy("chunk"))
    start = F.when(F.col("chunk") == 0, 1).otherwise(F.col("page_num"))
    end = F.when(F.col("after").isNull(), F.col("total")).otherwise(F.greatest(F.col("start"), F.col("after") - 1))
    spans = firsts.withColumn("after", after).withColumn("start", start).join(total, "doc_id").withColumn("end", end)
    return spans.select(
        "doc_id", (F.col("chunk") + 1).cast("int").alias("chunk_no"), F.greatest(F.lit(1), F.col("start") - overlap).alias("first_page"), F.least("total", F.col("end") + overlap).alias("last_page")
    )


def chunk_plans(pages: DataFrame, amended: DataFrame | None = None, chars: int = WHOLE_CHARS, articles: int = WHOLE_ARTICLES) -> DataFrame:
    """doc_id, n_chars, n_articles, strategy: `whole`, or `pasal-aware` or `page-based` where a text is too long or has too many articles.

    amended: doc_id of amendments, for which the number of articles doesn't count.
    """
    heads = F.regexp_extract_all("raw_text", F.lit(ARTICLE_HEADING), F.lit(0))
    g = pages.groupBy("doc_id").agg(F.sum(F.length("raw_text")).alias("n_chars"), F.sum(F.size(heads)).alias("n_articles"))
    if amended is not None:
        g = g.join(amended.select("doc_id").distinct().withColumn("amended", F.lit(True)), "doc_id", "left")
    else:
        g = g.withColumn("amended", F.lit(False))
    large = (F.col("n_chars") > chars) | (~F.coalesce("amended", F.lit(False)) & (F.col("n_articles") > articles))
    return g.select("doc_id", "n_chars", "n_articles", F.when(~large, "whole").when(F.col("n_articles") >= 2, "pasal-aware").otherwise("page-based").alias("strategy"))


def derived_id(title: Column, ancestor: Column) -> Column:
    """The id that a title gives a node: from its article, clause, letter and item, its chapter, section or paragraph."""
    t = F.lower(F.trim(title))
    part = lambda pattern, i=1: F.regexp_extract(t, pattern, i)
    within = F.when(ancestor != "", F.concat(ancestor, F.lit("_"))).otherwise("")
    article = r"^pasal\s+(\d+[a-z]?)(?:\s+ayat\s+\((\d+)\))?(?:\s+huruf\s+([a-z]+))?(?:\s+angka\s+(\d+))?"
    named = lambda label, i: F.when(part(article, i) != "", F.concat(F.lit(f"_{label}_"), part(article, i))).otherwise("")
    plain = F.nullif(F.substring(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9_]+", "_"), r"^_+|_+$", ""), 1, 60), F.lit(""))
    return (
        F.when(t.rlike(article), F.concat(F.lit("pasal_"), F.upper(part(article)), named("ayat", 2), named("huruf", 3), named("angka", 4)))
        .when(t.rlike(r"^bab\s+[ivxlc]+"), F.concat(F.lit("bab_"), part(r"^bab\s+([ivxlc]+)")))
        .when(t.rlike(r"^bagian\s+\w+"), F.concat(within, F.lit("bagian_"), part(r"^bagian\s+(\w+)")))
        .when(t.rlike(r"^paragraf\s+\d+"), F.concat(within, F.lit("paragraf_"), part(r"^paragraf\s+(\d+)")))
        .otherwise(F.coalesce(plain, F.lit("node")))
    )


def node_ids(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, node_id, kept: the id of a node if it is well formed, else one from its title. nodes: key, node_id, title, ancestor."""
    good = F.coalesce(F.trim("node_id").rlike("^[A-Za-z0-9_]+$"), F.lit(False))
    return nodes.select(*key, F.when(good, F.trim("node_id")).otherwise(derived_id(F.coalesce("title", F.lit("")), F.coalesce("ancestor", F.lit("")))).alias("node_id"), good.alias("kept"))


def navigation_paths(tree: DataFrame, key: str) -> DataFrame:
    """key, ord_path, path: the titles from the top down to each node, joined by ` > `. tree: key, ord_path, title.

    A node meets its ancestors by the beginnings of its ord_path, so the depth sets no number of rounds.
    """
    parts = F.split("ord_path", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    each = tree.select(key, "ord_path", F.posexplode(ups).alias("level", "up"))
    met = each.join(tree.select(key, F.col("ord_path").alias("up"), F.trim(F.coalesce("title", F.lit(""))).alias("t")), [key, "up"])
    return met.groupBy(key, "ord_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "t"))), lambda x: x["t"]), " > ").alias("path"))


def title_pages(current: DataFrame, pages: DataFrame, much: int = 4_000_000) -> DataFrame:
    """granularity, doc_id, node_id, found_page: the first page that holds the first 40 characters of a node's title, or the node's own.

    Titles are sought in every page of their document, but for documents of more than `much` characters times titles: there
    the pieces of a page that begin and end like some title are joined with the titles, which goes with the length of the pages.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    titles = current.select("granularity", "doc_id", "node_id", "start_index", F.substring(squeeze(F.col("title")), 1, 40).alias("needle")).where("needle is not null and needle <> ''")
    titles, pages = cut(titles), persist_table(pages.select("doc_id", "page_num", squeeze(F.col("raw_text")).alias("page")).where("page is not null"), "pages")
    needles = titles.select("doc_id", "needle").distinct()
    kinds = needles.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.collect_set(F.length("needle")).alias("sizes"),
        *[F.slice(F.collect_set(F.substring("needle", 1, q)), 1, FIRSTS + 1).alias(f"first{q}") for q in (5, 1)],
    )
    length = pages.groupBy("doc_id").agg(F.sum(F.length("page")).alias("chars"))
    few = lambda c: F.when(F.size(c) <= FIRSTS, F.col(c))
    long = cut(kinds.join(length, "doc_id").where(F.col("n") * F.col("chars") > much).select("doc_id", "sizes", F.coalesce(few("first5"), few("first1")).alias("firsts")))
    names = long.select("doc_id")

    plain = needles.join(names, "doc_id", "left_anti").join(pages.join(names, "doc_id", "left_anti"), "doc_id").where(F.contains("page", "needle")).select("doc_id", "needle", "page_num")
    pieces = pages.join(long, "doc_id").select("doc_id", "page_num", "page", "firsts", "sizes").mapInPandas(_pieces, StructType([pages.schema[c] for c in ("doc_id", "page_num")]).add("needle", "string"))
    found = plain.unionByName(pieces.join(needles, ["doc_id", "needle"], "left_semi").select("doc_id", "needle", "page_num"))
    first = found.groupBy("doc_id", "needle").agg(F.min("page_num").alias("page_num"))
    return titles.join(first, ["doc_id", "needle"], "left").groupBy("granularity", "doc_id", "node_id").agg(F.coalesce(F.min("page_num"), F.min("start_index")).alias("found_page"))


def _pieces(frames: Iterator[pd.DataFrame], step: int = 50_000) -> Iterator[pd.DataFrame]:
    """Of each page every piece of one of the `sizes` that begins with one of the `firsts`, or anywhere if there are none given."""
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            sizes, last = sorted(int(n) for n in r.sizes), len(r.page)
            for start in range(0, last, step):
                end = min(start + step, last)
                at = set(range(start, end)) if r.firsts is None else set()
                for f in r.firsts if r.firsts is not None else ():
                    i = r.page.find(f, start)
                    while -1 < i < end:
                        at.add(i)
                        i = r.page.find(f, i + 1)
                found = {r.page[i : i + n] for i in at for n in sizes if i + n <= last}
                yield pd.DataFrame({"doc_id": r.doc_id, "page_num": r.page_num, "needle": list(found)})


def with_newlines(text: Column) -> Column:
    """A text without any line break, with one before every clause mark; marks that follow a structural word are references."""
    words = "|".join(STRUCTURAL)
    broken = F.regexp_replace(text, r"\s+(\(\d+\)\s)", "\n$1")
    mended = F.regexp_replace(broken, rf"(?i)\b({words})\n", "$1 ")
    return F.when(F.contains(text, F.lit("\n")), text).otherwise(mended)


def elucidations(nodes: DataFrame) -> DataFrame:
    """load_id, label, told_md5: an elucidation by the clauses it speaks of; what stands before the first has label ''. Empty ones say nothing.

    A clause is a line that is `Ayat (n)`, or `Huruf x`, and holds what follows to the next.
    """
    rows = nodes.where("load_id is not null").select("load_id", F.coalesce(F.nullif(F.trim("penjelasan"), F.lit("")), F.lit(NOTHING_TO_SAY)).alias("t"))
    lines = rows.select("load_id", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    label = F.nullif(F.regexp_extract("line", r"^\s*((?:Ayat \(\d+\))|(?:Huruf [a-z]))\s*$", 1), F.lit(""))
    w = Window.partitionBy("load_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("own", label).withColumn("label", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit(""))).withColumn("part", F.count("own").over(w))
    each = marked.where("own is null").groupBy("load_id", "part", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return each.select("load_id", "part", "label", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("told_md5"))


def category_leaf_counts(counts: DataFrame) -> DataFrame:
    """folder, n_docs, total, least, most, mean, median: leaves a document in each folder. counts: doc_id, n. The median is cut to a whole number."""
    g = counts.withColumn("folder", F.split("doc_id", "-")[0]).groupBy("folder")
    return g.agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.round(F.avg("n"), 2).alias("mean"), F.floor(F.percentile("n", F.lit(0.5))).cast("bigint").alias("median"),
    )


def parse_errors(current: DataFrame) -> DataFrame:
    """granularity, doc_id, error: what is wrong with a parsed document.

    `no_articles`; `missing_articles` between the least and the largest; `doubled_titles`, more than one in twenty nodes;
    `empty_leaves`, more than five and a tenth of all; `hybrid_node`, a node with children and two or more clause marks of its own.
    """
    number = F.nullif(F.regexp_extract("node_id", r"^pasal_([0-9]+)", 1), F.lit("")).cast("int")
    marks = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^\([0-9]+\) "), F.lit(0)))
    g = current.groupBy("granularity", "doc_id").agg(
        F.count("*").alias("n"), F.count_distinct(number).alias("a"), (F.max(number) - F.min(number) + 1).alias("span"), F.count_distinct("title").alias("titles"), F.count("title").alias("titled"),
        F.sum((F.col("is_leaf") & (F.coalesce(F.trim("text"), F.lit("")) == "")).cast("bigint")).alias("empty"),
        F.sum((~F.col("is_leaf") & (marks >= 2)).cast("bigint")).alias("hybrid"),
    )
    rules = {
        "no_articles": F.col("a") == 0, "missing_articles": F.coalesce(F.col("span") > F.col("a"), F.lit(False)), "doubled_titles": (F.col("titled") - F.col("titles")) * 20 > F.col("n"),
        "empty_leaves": F.coalesce(F.col("empty"), F.lit(0)) > F.greatest(F.lit(5), F.floor(F.col("n") / 10)), "hybrid_node": F.coalesce(F.col("hybrid"), F.lit(0)) > 0,
    }
    return g.select("granularity", "doc_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))).alias("error"))
