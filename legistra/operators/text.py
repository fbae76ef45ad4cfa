"""Text operators: markers, references, chunks, slugs, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that carry no content, and words before a marker that make it a reference.
STOPWORDS = (
    "yang", "dan", "atau", "dari", "untuk", "dengan", "pada", "dalam", "oleh", "tidak", "akan", "adalah", "ini", "itu", "apa", "apakah",
    "bagaimana", "siapa", "kapan", "berapa", "mengapa", "jika", "agar", "bagi", "atas", "sebagai", "dapat", "harus",
)
REFERENCE_WORDS = ("ayat", "pasal", "huruf", "angka", "dan", "atau", "sampai")


def content_words(text: Column) -> Column:
    """The distinct words of three letters or more that carry content, in alphabetical order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """The similarity of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def paraphrase_overlap(items: DataFrame, nodes: DataFrame, limit: float = 0.4) -> DataFrame:
    """query_id, overlap, flagged of paraphrased questions against their anchor's text.

    items: query_id, query, doc_id, node_id. nodes: doc_id, node_id, text. Flagged if the overlap is over the limit or
    there is no such node.
    """
    joined = items.join(nodes.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left")
    raw = jaccard(content_words(F.col("query")), content_words(F.col("text")))
    scored = joined.withColumn("raw", F.when(F.col("text").isNotNull(), raw))
    return scored.select("query_id", F.round("raw", 3).alias("overlap"), (F.col("raw").isNull() | (F.col("raw") > limit)).alias("flagged"))


def reference_mode(query: Column) -> Column:
    """Whether a question names an article, a document, both or neither."""
    legal = query.rlike(r"(?i)\b(pasal|ayat|huruf)\s+\(?[0-9a-z]+")
    doc = query.rlike(r"(?i)\b(uu|pp|perpres|perda|pergub|permen[a-z]*|peraturan[a-z]*)\s+(nomor|no)\b")
    return F.when(legal & doc, "both").when(legal, "legal_ref").when(doc, "doc_only").otherwise("none")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters, digits and dots as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9.]+", "-"), r"^-+|-+$", "")


def markers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, kind, label: lines that begin with (1), a. or 1., unless the line before ends in a reference word."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    before = F.lower(F.regexp_extract(F.trim(F.coalesce(F.lag("line").over(w), F.lit(""))), r"([A-Za-z]+)$", 1))
    kind = F.when(F.col("line").rlike(r"^\([0-9]+[a-z]?\) "), "ayat").when(F.col("line").rlike(r"^[a-z]\. "), "huruf").when(F.col("line").rlike(r"^[0-9]+\. "), "angka")
    label = F.regexp_extract("line", r"^\(?([0-9]+[a-z]?|[a-z])[.)] ", 1)
    found = lines.withColumn("before", before).withColumn("kind", kind).withColumn("label", label)
    return found.where(F.col("kind").isNotNull() & ~F.col("before").isin(*REFERENCE_WORDS)).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "kind", "label")


def split_at_markers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, label, n_lines, text_md5: the text before the first (1) as part 0, then each clause to the next."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("line").rlike(r"^\([0-9]+\) ").cast("int")
    part = lines.withColumn("part", F.sum(opens).over(w))
    grouped = part.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return grouped.select(
        key, F.col("part").cast("bigint").alias("part"), F.regexp_extract(body, r"^\(([0-9]+)\) ", 1).alias("label"), F.size("ls").cast("bigint").alias("n_lines"), F.md5(body).alias("text_md5")
    )


def gap_ranges(found: DataFrame, key: str) -> DataFrame:
    """key, gap_from, gap_to: runs of clause numbers that are absent between two that are there. found: markers."""
    have = found.where("kind = 'ayat'").select(key, F.regexp_extract("label", "([0-9]+)", 1).cast("int").alias("n")).distinct()
    after = have.withColumn("after", F.lead("n").over(Window.partitionBy(key).orderBy("n")))
    return after.where("after - n > 1").select(key, (F.col("n") + 1).alias("gap_from"), (F.col("after") - 1).alias("gap_to"))


def numbering_gaps(found: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """key, missing: clause numbers that are absent between the least and the largest. found: markers.

    One marker that is far off gives a row for every number up to it; gap_ranges tells them in one.
    """
    # in blocks, so that no array is long
    starts = F.explode(F.sequence(F.col("gap_from").cast("bigint"), F.col("gap_to").cast("bigint"), F.lit(block).cast("bigint")))
    blocks = gap_ranges(found, key).select(key, "gap_to", starts.alias("lo"))
    each = blocks.select(key, F.explode(F.sequence("lo", F.least(F.col("lo") + block - 1, F.col("gap_to").cast("bigint")))).alias("missing"))
    return each.withColumn("missing", F.col("missing").cast("int"))


def page_chunks(docs: DataFrame, key: str, pages: str, size: int = 10, overlap: int = 4) -> DataFrame:
    """key, chunk_no, first_page, last_page: windows of pages that overlap; none begins after one has reached the end."""
    step = size - overlap
    last_start = F.greatest(F.lit(1), F.ceil((F.col(pages) - size) / step).cast("int") * step + 1)
    starts = docs.where(F.col(pages) >= 1).select(key, F.col(pages).alias("__n"), F.posexplode(F.sequence(F.lit(1), last_start, F.lit(step))).alias("i", "first_page"))
    return starts.select(key, (F.col("i") + 1).alias("chunk_no"), "first_page", F.least(F.col("first_page") + size - 1, F.col("__n")).alias("last_page"))


def cleaning_accepted(before: Column, after: Column) -> Column:
    """Whether a cleaned text may replace the old one: about as long, and no clause marker lost."""
    ratio = F.length(after) / F.nullif(F.length(before), F.lit(0))
    count = lambda c: F.regexp_count(c, F.lit(r"\([0-9]+\)"))
    return F.coalesce((ratio >= 0.85) & (ratio <= 1.15) & (count(after) >= count(before)), F.lit(False))
