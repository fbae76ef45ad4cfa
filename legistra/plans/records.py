"""Queries on bookkeeping: splits, references, hints, signatures, costs, versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from legistra.functions.model_text import json_array_in, without_fence
from legistra.operators import bookkeeping as bk
from legistra.operators import corpus_tables as ct
from legistra.operators import quality as dq
from legistra.operators.summaries import unique_runs
from legistra.plans import analysis, reading
from legistra.plans import search as se
from legistra.plans.analysis import U
from legistra.plans.reading import ITEMS
from legistra.plans.search import CUR, MODEL, A
from legistra.session import table_path
from legistra.sources.tables import table


def v_val_members(spark, sf):
    return bk.split_members(table(spark, sf, "gt_splits"), "val")


def v_provenance(spark, sf):
    """Where a record comes from: an override by kind of document and type, else the default."""
    over = spark.createDataFrame([("uu", "factual", "manual", "reviewed"), ("pp", "multihop", "script", "draft")], "kind string, query_type string, origin string, state string")
    items = reading._items(spark, sf).select("query_id", F.split("doc_id", "-")[0].alias("kind"), "query_type")
    return bk.with_overrides(items, over, ["kind", "query_type"], {"origin": "model", "state": "raw"})


def v_signatures(spark, sf):
    r = unique_runs(table(spark, sf, "query_runs"))
    return r.groupBy("system", bk.signature(("system", "eval_granularity", "llm_model")).alias("signature")).agg(F.count("*").alias("n"))


def v_file_types(spark, sf):
    reg = table(spark, sf, "registry").where("doc_id is not null")
    stem = F.when(F.col("scrape_id") % 3 == 0, F.concat("doc_id", F.lit("__multihop__x"))).otherwise(F.col("doc_id"))
    return reg.select("scrape_id", bk.file_type(stem).alias("kind"))


def v_seeded_sample(spark, sf):
    return bk.seeded_sample(reading._items(spark, sf).select("query_id", "query_type"), "query_type", "query_id", 5)


def r_resolved_refs(spark, sf):
    nodes = se._candidates(spark, sf, "rerank_position", ascending=True).select("query_id", F.substring_index("item", "/", -1).alias("node"), F.col("rank").alias("pos"))
    return bk.resolved_refs(nodes, se._by_bm25(spark, sf).withColumnRenamed("item", "ref"))


def r_budget_hints(spark, sf):
    c = se._candidates(spark, sf, "rerank_position", ascending=True).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    steps = c.select("query_id", F.col("rank").alias("step"), F.when(F.col("rank") == F.col("n"), "submit").otherwise("read").alias("action"))
    return bk.budget_hints(steps, 12, 8)


def a_index_costs(spark, sf):
    """Characters read, nodes split off and characters of summaries, by kind of document: what indexing works through."""
    cur = ct.current_nodes(table(spark, sf, "nodes"))
    log = cur.groupBy(F.split("doc_id", "-")[0].alias("category"), "doc_id", "granularity").agg(
        F.sum(F.length("text")).alias("parse"), F.count("*").alias("resplit"), F.sum(F.length("summary")).alias("summary")
    )
    return bk.stage_costs(log, ("parse", "resplit", "summary"), "resplit", "pasal")


def a_review(spark, sf):
    """Records and those without an error, by kind of document."""
    items = reading._items(spark, sf).select("query_id", F.split("doc_id", "-")[0].alias("kind"))
    bad = dq.gt_errors(table(spark, sf, "gt_items"), ct.current_nodes(table(spark, sf, "nodes"))).select("query_id").distinct().withColumn("bad", F.lit(1))
    good = F.sum(F.when(F.col("bad").isNull(), 1).otherwise(0))
    return items.join(bad, "query_id", "left").groupBy("kind").agg(F.count("*").alias("n"), good.alias("n_good"), F.round(100 * good / F.count("*"), 1).alias("percent_good"))


def a_warning_classes(spark, sf):
    """Warnings of a check of parsed documents by class."""
    e = reading.d_parse_errors(spark, sf)
    text = F.when(F.col("error") == "missing_articles", F.concat(F.lit("Gap in Pasal of "), "doc_id")).when(F.col("error") == "no_articles", "Failed to parse LLM answer").otherwise(F.col("error"))
    return e.groupBy(bk.warning_class(text).alias("class")).agg(F.count("*").alias("n"))


def t_restored(spark, sf):
    rows = table(spark, sf, "nodes").where("granularity is not null and doc_id is not null and node_id is not null")
    return bk.previous_versions(rows, ["granularity", "doc_id", "node_id"], ["loaded_at", "load_id"]).select("granularity", "doc_id", "node_id", "load_id")


def c_vector_table(spark, sf):
    """Vectors with their label as payload, written anew as a table, and read back."""
    path = table_path(spark, "vectors")
    table(spark, sf, "embeddings").where("vec_id is not null").select("vec_id", "embedding", "label").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding").cast("bigint")).alias("n_values"))


def c_model_answers(spark, sf):
    """Arrays that a model wrote inside fences and prose, read back."""
    reg = table(spark, sf, "registry").where("nomor is not null")
    body = F.concat(F.lit('["'), "nomor", F.lit('", "]"]'))
    said = F.when(F.col("scrape_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" [done")))
    first = json_array_in(without_fence(F.col("said")))
    return reg.select("scrape_id", said.alias("said")).select("scrape_id", F.from_json(first, "array<string>")[0].alias("nomor"))


QUERIES = {
    n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("v_", "r_", "a_", "t_", "c_") and getattr(f, "__module__", "") == __name__
}

# ---------------------------------------------------------------- SQL

_GT = analysis.ORACLES["d_gt_errors"]
_PARSE = reading.ORACLES["d_parse_errors"]
_SETTINGS = " || chr(1) || ".join(f"coalesce({f}::VARCHAR, chr(2))" for f in ("system", "eval_granularity", "llm_model"))

ORACLES = {
    "v_val_members": "SELECT DISTINCT query_id FROM gt_splits WHERE split_name = 'val' AND query_id IS NOT NULL",
    "v_provenance": f"""WITH {ITEMS}, k AS (SELECT query_id, string_split(doc_id, '-')[1] AS kind, query_type FROM it)
SELECT *, CASE WHEN kind = 'uu' AND query_type = 'factual' THEN 'manual' WHEN kind = 'pp' AND query_type = 'multihop' THEN 'script' ELSE 'model' END AS origin, CASE WHEN kind = 'uu' AND query_type = 'factual' THEN 'reviewed' WHEN kind = 'pp' AND query_type = 'multihop' THEN 'draft' ELSE 'raw' END AS state FROM k""",
    "v_signatures": f"WITH {U} SELECT system, md5({_SETTINGS}) AS signature, count(*) AS n FROM u GROUP BY ALL",
    "v_file_types": "SELECT scrape_id, CASE WHEN scrape_id % 3 = 0 THEN 'multihop__x' ELSE 'factual' END AS kind FROM registry WHERE doc_id IS NOT NULL",
    "v_seeded_sample": f"WITH {ITEMS} SELECT * FROM (SELECT query_id, query_type, row_number() OVER (PARTITION BY query_type ORDER BY md5('42|' || query_id::VARCHAR), query_id)::INT AS place FROM it) WHERE place <= 5",
    "r_resolved_refs": f"""WITH {A}, {MODEL}, f AS (SELECT query_id, string_split(item, '/')[-1] AS node, min(pos) AS pos FROM m GROUP BY ALL),
c AS (SELECT a.query_id, item AS ref, rank, pos, row_number() OVER (PARTITION BY a.query_id, string_split(item, '/')[-1] ORDER BY rank) AS nth FROM a LEFT JOIN f ON f.query_id = a.query_id AND f.node = string_split(item, '/')[-1]),
g AS (SELECT *, CASE WHEN pos IS NULL THEN 2 WHEN nth = 1 THEN 0 ELSE 1 END AS grp FROM c) SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY grp, CASE WHEN grp = 0 THEN pos ELSE rank END)::INT AS rank FROM g""",
    "r_budget_hints": """WITH c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_position, cand_id)::INT AS step, count(*) OVER (PARTITION BY query_id) AS n FROM retrieved WHERE rerank_position IS NOT NULL)
SELECT query_id, step, CASE WHEN step >= 7 THEN 'actions' ELSE 'reads' END AS hint FROM c WHERE step < n AND step >= 5""",
    "a_index_costs": f"""WITH {CUR}, l AS (SELECT string_split(doc_id, '-')[1] AS category, doc_id, granularity, coalesce(sum(length(text)), 0)::DOUBLE AS parse, count(*)::DOUBLE AS resplit, coalesce(sum(length(summary)), 0)::DOUBLE AS summary FROM cur GROUP BY ALL),
e AS (SELECT category, doc_id, 'parse' AS stage, parse AS cost FROM l UNION ALL SELECT category, doc_id, 'resplit', resplit FROM l WHERE granularity = 'pasal' UNION ALL SELECT category, doc_id, 'summary', summary FROM l),
d AS (SELECT category, stage, doc_id, sum(cost) AS cost FROM e GROUP BY ALL)
SELECT category, stage, count(*) AS n_docs, round(sum(cost), 2) AS total, round(avg(cost), 2) AS mean FROM d GROUP BY GROUPING SETS ((category, stage), (stage))""",
    "a_review": f"""WITH {ITEMS}, bad AS ({_GT}) SELECT string_split(doc_id, '-')[1] AS kind, count(*) AS n, count(*) FILTER (WHERE query_id NOT IN (SELECT query_id FROM bad)) AS n_good,
  round(100 * count(*) FILTER (WHERE query_id NOT IN (SELECT query_id FROM bad)) / count(*)::DOUBLE, 1) AS percent_good FROM it GROUP BY 1""",
    "a_warning_classes": f"SELECT CASE WHEN error = 'missing_articles' THEN 'gap' WHEN error = 'no_articles' THEN 'model' ELSE 'other' END AS class, count(*) AS n FROM ({_PARSE}) GROUP BY 1",
    "t_restored": "SELECT granularity, doc_id, node_id, load_id FROM (SELECT *, row_number() OVER (PARTITION BY granularity, doc_id, node_id ORDER BY loaded_at DESC, load_id DESC) AS rn FROM nodes WHERE granularity IS NOT NULL AND doc_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 2",
    "c_vector_table": "SELECT label, count(*) AS n, sum(len(embedding))::BIGINT AS n_values FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1",
    "c_model_answers": "SELECT scrape_id, nomor FROM registry WHERE nomor IS NOT NULL",
}
