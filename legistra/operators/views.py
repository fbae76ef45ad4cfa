"""What a model or a reader is shown of the corpus: chunk texts, slim catalogs, outlines, contexts; and how records are picked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legistra.operators.corpus_tables import KEY, NO_EXPLANATION

# Words in the path of a preamble, and the heading of an elucidation.
PREAMBLE = ("Menimbang", "Mengingat", "Menetapkan", "Pembukaan")
ELUCIDATION = "\n\nPenjelasan Resmi:\n"


def chunk_text(text: Column, penjelasan: Column) -> Column:
    """The text a leaf is embedded by: its own, and the elucidation under a heading unless that says nothing."""
    told = F.coalesce((penjelasan != "") & (penjelasan != NO_EXPLANATION), F.lit(False))
    base = F.coalesce(text, F.lit(""))
    return F.when(told, F.concat(base, F.lit(ELUCIDATION), penjelasan)).otherwise(base)


def slim_catalog(catalog: DataFrame, cap: int = 600) -> DataFrame:
    """doc_id, judul, bentuk_singkat, summary: a catalog short enough for a prompt. The summary is cut, and null if empty."""
    return catalog.select("doc_id", "judul", "bentuk_singkat", F.nullif(F.substring(F.coalesce("summaries", F.lit("")), 1, cap), F.lit("")).alias("summary"))


def outlines(current: DataFrame) -> DataFrame:
    """granularity, doc_id, n_lines, outline: a document's nodes in reading order, one a line, two blanks a level.

    A line is `- [node_id] title :: summary`, without what is empty. The whole outline of a document is one value.
    """
    line = F.concat(
        F.repeat(F.lit("  "), F.greatest(F.coalesce("depth", F.lit(1)) - 1, F.lit(0))), F.lit("- ["), F.col("node_id"), F.lit("]"),
        F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.concat(F.lit(" "), F.trim("title"))).otherwise(""),
        F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.concat(F.lit(" :: "), F.trim("summary"))).otherwise(""),
    )
    rows = current.select("granularity", "doc_id", F.struct("ord_path", "node_id", line.alias("line")).alias("l"))
    each = rows.groupBy("granularity", "doc_id").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return each.select("granularity", "doc_id", F.size("ls").cast("bigint").alias("n_lines"), F.md5(text).alias("outline_md5"))


def picked_queries(items: DataFrame, types: Sequence[str] | None = None, doc: str | None = None, a_type: int | None = None, most: int | None = None) -> DataFrame:
    """Records (query_id, query_type, doc_id) in the order of their ids: by document, then types, then so many a type, then so many.

    A missing type is `factual`. The limits are the feature: a head of each type, and of all.
    """
    kept = items.withColumn("query_type", F.coalesce(F.nullif("query_type", F.lit("")), F.lit("factual")))
    if doc is not None:
        kept = kept.where(F.col("doc_id") == doc)
    if types is not None:
        kept = kept.where(F.col("query_type").isin(*types))
    if a_type is not None:
        w = Window.partitionBy("query_type").orderBy("query_id")
        kept = kept.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= a_type).drop("__n")
    if most is not None:
        kept = kept.orderBy("query_id").limit(most)
    return kept


def matching(items: DataFrame, doc_part: str | None = None, word: str | None = None, **equal: str) -> DataFrame:
    """Records whose document holds doc_part and whose question holds word, both without case, and whose fields are as given."""
    kept = items
    if doc_part is not None:
        kept = kept.where(F.contains(F.lower("doc_id"), F.lit(doc_part.lower())))
    if word is not None:
        kept = kept.where(F.contains(F.lower("query"), F.lit(word.lower())))
    for field, value in equal.items():
        kept = kept.where(F.col(field) == value)
    return kept


def without_preamble(leaves: DataFrame) -> DataFrame:
    """Leaves without those whose path names a preamble; a document that has no others keeps all."""
    named = F.lit(False)
    for word in PREAMBLE:
        named = named | F.contains(F.coalesce("navigation_path", F.lit("")), F.lit(word))
    by = Window.partitionBy("granularity", "doc_id")
    marked = leaves.withColumn("__body", ~named).withColumn("__any", F.max("__body").over(by))
    return marked.where("__body or not __any").drop("__body", "__any")


def anchor_pairs(docs: Column, anchors: Column, doc: Column, anchor: Column) -> Column:
    """(doc, anchor) pairs: the lists side by side if they are as long as each other, else the first document for every anchor."""
    many = F.coalesce(anchors, F.array().cast("array<string>"))
    own = F.coalesce(docs, F.array().cast("array<string>"))
    side = F.transform(F.arrays_zip(own.alias("d"), many.alias("a")), lambda x: F.struct(x["d"].alias("doc"), x["a"].alias("anchor")))
    first = F.coalesce(doc, F.try_element_at(own, F.lit(1)))
    for_all = F.transform(many, lambda a: F.struct(first.alias("doc"), a.alias("anchor")))
    single = F.array(F.struct(first.alias("doc"), anchor.alias("anchor")))
    return F.when(F.size(many) == 0, single).when(F.size(own) == F.size(many), side).otherwise(for_all)


def with_defaults(items: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """items with null and blank fields filled in."""
    filled = {f: F.coalesce(F.when(F.trim(f) != "", F.col(f)), F.lit(v)) for f, v in defaults.items()}
    return items.withColumns(filled)


def payloads(runs: DataFrame) -> DataFrame:
    """run_id, ok, error: a worker's answer brought to one form. No answer, a failed one, and a good one are told apart."""
    missing = F.col("worker_ok").isNull()
    error = F.when(missing, "Missing worker payload").when(~F.col("worker_ok"), F.coalesce(F.nullif("error", F.lit("")), F.lit("Worker error"))).otherwise(F.coalesce("error", F.lit("")))
    return runs.select("run_id", F.coalesce("worker_ok", F.lit(False)).alias("ok"), error.alias("error"))


def grouped_rendering(leaves: DataFrame) -> DataFrame:
    """granularity, doc_id, n_sections, text_md5: leaves in reading order, a header where the section changes.

    The section is the path without its last step.
    """
    section = F.regexp_replace(F.coalesce("navigation_path", F.lit("")), r"( > )?[^>]*$", "")
    by = Window.partitionBy("granularity", "doc_id").orderBy("ord_path", "node_id")
    rows = leaves.select("granularity", "doc_id", "ord_path", "node_id", "title", section.alias("section"))
    opens = F.coalesce(F.col("section") != F.lag("section").over(by), F.lit(True))
    line = F.concat(F.when(F.col("opens"), F.concat(F.lit("## "), F.col("section"), F.lit("\n"))).otherwise(""), F.lit("- "), F.coalesce("title", F.lit("")))
    marked = rows.withColumn("opens", opens)
    each = marked.groupBy("granularity", "doc_id").agg(F.sum(F.col("opens").cast("bigint")).alias("n_sections"), F.sort_array(F.collect_list(F.struct("ord_path", "node_id", line.alias("line")))).alias("ls"))
    return each.select("granularity", "doc_id", "n_sections", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text_md5"))


def contexts(anchors: DataFrame, nodes: DataFrame, cap: int = 600) -> DataFrame:
    """doc_id, node_id, context_md5: the texts of distinct anchors, cut with dots where longer than cap. Unknown anchors are left out."""
    known = nodes.where("text is not null").groupBy("doc_id", "node_id").agg(F.max_by("text", "load_id").alias("text"))
    met = anchors.select("doc_id", "node_id").distinct().join(known, ["doc_id", "node_id"])
    cut = F.when(F.length("text") > cap, F.concat(F.substring("text", 1, cap), F.lit(" ..."))).otherwise(F.col("text"))
    return met.select("doc_id", "node_id", F.md5(cut).alias("context_md5"))


def sibling_hints(wrong: DataFrame, current: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, asked, node_id, rank: for a node id that a document doesn't have, the first nodes it may mean.

    Those whose id begins with the same word, or if there are none the document's first ones, in reading order.
    """
    head = lambda c: F.split(c, "_")[0]
    met = wrong.select("doc_id", F.col("node_id").alias("asked")).distinct().join(current.select("doc_id", "node_id", "ord_path").distinct(), "doc_id")
    like = met.withColumn("same", head(F.col("node_id")) == head(F.col("asked")))
    by = Window.partitionBy("doc_id", "asked")
    kept = like.withColumn("any", F.max("same").over(by)).where("same or not any")
    return kept.withColumn("rank", F.row_number().over(by.orderBy("ord_path", "node_id"))).where(F.col("rank") <= most).select("doc_id", "asked", "node_id", "rank")


def found_nodes(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, node_id, granularity, load_id: the first node in reading order with a wanted id; unknown ids are left out."""
    met = wanted.select("doc_id", "node_id").distinct().join(current, ["doc_id", "node_id"])
    return met.groupBy("doc_id", "node_id").agg(F.min(F.struct("ord_path", "granularity", "load_id")).alias("m")).select("doc_id", "node_id", "m.granularity", "m.load_id")


def catalog_report(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, state: the wanted documents, `kept` if the catalog has them and `missing` if not."""
    known = catalog.select("doc_id").where("doc_id is not null").distinct()
    asked = wanted.select("doc_id").where("doc_id is not null").distinct()
    return asked.join(known, "doc_id", "left_semi").withColumn("state", F.lit("kept")).unionByName(asked.join(known, "doc_id", "left_anti").withColumn("state", F.lit("missing")))


def missing_files(expected: DataFrame, current: DataFrame, granularities: Sequence[str] = ("pasal", "ayat", "rincian")) -> DataFrame:
    """doc_id, granularity: what should be indexed and isn't."""
    every = expected.select("doc_id").where("doc_id is not null").distinct().select("doc_id", F.explode(F.array(*[F.lit(g) for g in granularities])).alias("granularity"))
    return every.join(current.select("doc_id", "granularity").distinct(), ["doc_id", "granularity"], "left_anti")


def targets(registry: DataFrame, category: str, explicit: Sequence[str] | None = None) -> DataFrame:
    """doc_id, place: the ids given, in their order; without any, those of a category, compared without case, in order."""
    if explicit:
        return registry.sparkSession.createDataFrame([(d, i) for i, d in enumerate(explicit, 1)], "doc_id string, place int")
    kept = registry.where(F.upper("jenis_folder") == category.upper()).select("doc_id").where("doc_id is not null").distinct()
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(category)).orderBy("doc_id")))


def natural_order(current: DataFrame) -> DataFrame:
    """granularity, doc_id, node_id, place: articles by the number in their id, then by what follows it."""
    number = F.regexp_extract("node_id", r"pasal_([0-9]+)", 1).try_cast("int")
    suffix = F.regexp_extract("node_id", r"pasal_[0-9]+(.*)$", 1)
    by = Window.partitionBy("granularity", "doc_id").orderBy(number.asc_nulls_last(), suffix, "node_id")
    return current.select(*KEY, F.row_number().over(by).alias("place"))


def gold_union(items: DataFrame) -> DataFrame:
    """doc_id, n_queries, n_anchors: the union of a document's gold anchors over its records. items: query_id, doc_id, anchors."""
    each = items.where("doc_id is not null").select("query_id", "doc_id", F.explode_outer("anchors").alias("a"))
    return each.groupBy("doc_id").agg(F.count_distinct("query_id").alias("n_queries"), F.count_distinct("a").alias("n_anchors"))


def config_drift(runs: DataFrame, fields: Sequence[str] = ("llm_model", "eval_granularity")) -> DataFrame:
    """system, field, n_values, state: whether a system ran with one setting throughout; `differs` would stop a resume."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in fields])
    long = runs.select("system", F.inline(each)).distinct()
    return long.groupBy("system", "field").agg(F.count("*").alias("n_values")).withColumn("state", F.when(F.col("n_values") > 1, "differs").otherwise("same"))
