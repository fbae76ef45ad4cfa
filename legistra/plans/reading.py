"""Queries on what models and readers are shown, on records of evaluation, and on the way from pages to trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from legistra.functions.ids import canonical_doc, canonical_node, gold_doc, gold_docs
from legistra.operators import corpus_tables as ct
from legistra.operators import evaluation as ev
from legistra.operators import metrics as mt
from legistra.operators import nested
from legistra.operators import parsing as ps
from legistra.operators import views as vw
from legistra.operators.summaries import unique_runs
from legistra.plans import search as se
from legistra.plans.analysis import GA, GD, REG, U, _error_case
from legistra.plans.corpus import DOC, NODE
from legistra.plans.search import CATALOG, CUR, LEAF, PER_QUERY, SIB, A, _list
from legistra.sources.tables import table


def _cur(spark, sf):
    return ct.current_nodes(table(spark, sf, "nodes"))


def _items(spark, sf):
    doc = gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids"))
    return ct.newest(table(spark, sf, "gt_items").where("query_id is not null"), ["query_id"], ["created_at"]).withColumn("doc_id", doc)


# ---------------------------------------------------------------- views


def v_chunk_texts(spark, sf):
    leaf = ct.leaves(_cur(spark, sf))
    return leaf.select("load_id", F.md5(vw.chunk_text(F.col("text"), F.col("penjelasan"))).alias("chunk_md5"))


def v_slim_catalog(spark, sf):
    reg = ct.newest(table(spark, sf, "registry").where("doc_id is not null"), ["doc_id"], ["scraped_at", "scrape_id"])
    return vw.slim_catalog(reg.join(se._summaries(_cur(spark, sf)), "doc_id", "left"))


def v_outlines(spark, sf):
    return vw.outlines(_cur(spark, sf))


def v_picked_queries(spark, sf):
    return vw.picked_queries(_items(spark, sf).select("query_id", "query_type", "doc_id"), types=("factual", "paraphrased"), a_type=20, most=30)


def v_matching(spark, sf):
    return vw.matching(_items(spark, sf), doc_part="UU", word="wajib", query_type="factual").select("query_id", "doc_id")


def v_without_preamble(spark, sf):
    return vw.without_preamble(ct.leaves(_cur(spark, sf))).select("granularity", "doc_id", "node_id")


def v_anchor_pairs(spark, sf):
    pairs = vw.anchor_pairs(F.col("gold_doc_ids"), F.col("gold_anchor_node_ids"), F.col("gold_doc_id"), F.col("gold_anchor_node_id"))
    rows = table(spark, sf, "gt_items").select("query_id", F.posexplode(pairs).alias("pos", "p")).distinct()
    return rows.select("query_id", "pos", canonical_doc(F.col("p.doc")).alias("doc"), canonical_node(F.col("p.anchor")).alias("anchor"))


def v_defaults(spark, sf):
    filled = vw.with_defaults(_items(spark, sf), {"query_type": "factual", "query_style": "formal", "reference_mode": "none", "gold_anchor_granularity": "pasal"})
    return filled.select("query_id", "query_type", "query_style", "reference_mode", "gold_anchor_granularity")


def v_payloads(spark, sf):
    return vw.payloads(unique_runs(table(spark, sf, "query_runs")))


def v_rendered(spark, sf):
    return vw.grouped_rendering(ct.leaves(_cur(spark, sf)))


def v_contexts(spark, sf):
    anchors = table(spark, sf, "gt_items").select(gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")).alias("doc_id"), canonical_node(F.col("gold_anchor_node_id")).alias("node_id"))
    nodes = _cur(spark, sf).select(canonical_doc(F.col("doc_id")).alias("doc_id"), canonical_node(F.col("node_id")).alias("node_id"), "text", "load_id")
    return vw.contexts(anchors.where("doc_id is not null and node_id is not null"), nodes, 300)


def v_sibling_hints(spark, sf):
    """For gold articles that a document doesn't have, what else it has."""
    cur = _cur(spark, sf).where("granularity = 'pasal'").select(canonical_doc(F.col("doc_id")).alias("doc_id"), canonical_node(F.col("node_id")).alias("node_id"), "ord_path")
    asked = _items(spark, sf).select("doc_id", canonical_node(F.col("gold_node_id")).alias("node_id")).where("doc_id is not null and node_id is not null")
    return vw.sibling_hints(asked.join(cur, ["doc_id", "node_id"], "left_anti"), cur)


def v_found_nodes(spark, sf):
    cur = _cur(spark, sf).withColumn("doc_id", canonical_doc(F.col("doc_id"))).withColumn("node_id", canonical_node(F.col("node_id")))
    asked = _items(spark, sf).select("doc_id", canonical_node(F.col("gold_anchor_node_id")).alias("node_id")).where("doc_id is not null and node_id is not null")
    return vw.found_nodes(asked, cur)


def v_catalog_report(spark, sf):
    reg = table(spark, sf, "registry").select(canonical_doc(F.col("doc_id")).alias("doc_id"))
    asked = table(spark, sf, "gt_items").select(F.explode(gold_docs(F.col("gold_doc_id"), F.col("gold_doc_ids"))).alias("doc_id"))
    return vw.catalog_report(reg, asked)


def v_missing_files(spark, sf):
    return vw.missing_files(table(spark, sf, "registry"), _cur(spark, sf))


def v_targets(spark, sf):
    return vw.targets(table(spark, sf, "registry"), "perda")


def v_natural_order(spark, sf):
    return vw.natural_order(_cur(spark, sf))


def v_gold_union(spark, sf):
    anchors = F.array_distinct(F.filter(F.transform(F.concat(F.array("gold_anchor_node_id"), F.coalesce("gold_anchor_node_ids", F.array().cast("array<string>"))), canonical_node), lambda x: x.isNotNull()))
    return vw.gold_union(_items(spark, sf).select("query_id", "doc_id", anchors.alias("anchors")))


def v_config_drift(spark, sf):
    return vw.config_drift(unique_runs(table(spark, sf, "query_runs")))


def v_split_check(spark, sf):
    """Whether each split is what its fingerprint says, after one query is moved out of `val`."""
    from legistra.operators.summaries import fingerprints

    held = table(spark, sf, "gt_splits")
    first = held.where("split_name = 'val'").agg(F.min("query_id").alias("moved"))
    changed = held.join(F.broadcast(first), F.col("query_id") == F.col("moved"), "left_anti")
    both = fingerprints(held).alias("a").join(fingerprints(changed).alias("b"), "split_name")
    return both.select("split_name", (F.col("a.fingerprint") == F.col("b.fingerprint")).alias("same"))


# ---------------------------------------------------------------- evaluation


def a_run_summary(spark, sf):
    return ev.run_summary(table(spark, sf, "query_runs"))


def a_step_costs(spark, sf):
    return ev.step_costs(table(spark, sf, "query_runs"))


def a_overview(spark, sf):
    return ev.final_overview(table(spark, sf, "query_runs"))


def _records(spark, sf):
    return ev.query_records(se._by_bm25(spark, sf), se._gold(spark, sf))


def m_records(spark, sf):
    return _records(spark, sf)


def _described(spark, sf):
    g = _items(spark, sf).select("query_id", "reference_mode", "query_style", F.col("doc_id").alias("gold_doc_id"), "query_type")
    return _records(spark, sf).join(g, "query_id")


def m_summary(spark, sf):
    return ev.summary_of(_described(spark, sf), ["query_type"])


def m_by_reference_mode(spark, sf):
    return ev.summary_of(_described(spark, sf).where(F.col("reference_mode").isin("none", "legal_ref", "doc_only", "both")), ["reference_mode"])


def m_slices(spark, sf):
    return ev.by_slices(_described(spark, sf), ("reference_mode", "query_style", "gold_doc_id", "query_type"))


def m_by_node_id(spark, sf):
    """The metrics where only the node id counts, whatever its document."""
    strip = lambda d: d.withColumn("item", F.substring_index("item", "/", -1))
    return mt.per_query(mt.ranked_unique(strip(se._by_bm25(spark, sf)), "item"), strip(se._gold(spark, sf)).distinct(), "item")


# ---------------------------------------------------------------- pages and trees


def _pages(spark, sf):
    return ps.pages_of(_cur(spark, sf))


def x_clean_pages(spark, sf):
    return _pages(spark, sf).select("doc_id", "page_num", F.md5(ps.cleaned_page(F.col("raw_text"))).alias("text_md5"))


def x_page_roles(spark, sf):
    return ps.page_roles(_pages(spark, sf))


def x_amendments(spark, sf):
    return ps.amendments(table(spark, sf, "registry"))


def x_formatted_pages(spark, sf):
    return ps.formatted_pages(_pages(spark, sf))


def _outline_pages(spark, sf):
    """Pages with their articles' headings, as a scanned regulation has them."""
    cur = _cur(spark, sf).where("granularity = 'pasal'")
    return ps.pages_of(cur.withColumn("text", F.concat(F.col("title"), F.lit("\n"), F.coalesce("text", F.lit("")))))


def x_article_chunks(spark, sf):
    return ps.article_chunks(_outline_pages(spark, sf), 5)


def x_chunk_plans(spark, sf):
    return ps.chunk_plans(_outline_pages(spark, sf), chars=5000, articles=12)


def t_node_ids(spark, sf):
    t = nested.node_table(table(spark, sf, "tree_docs"))
    up = t.select("raw_id", F.col("ord_path").alias("parent_path"), F.col("node_id").alias("ancestor"))
    return ps.node_ids(t.join(up, ["raw_id", "parent_path"], "left"), ["raw_id", "ord_path"])


def t_navigation_paths(spark, sf):
    p = ps.navigation_paths(nested.node_table(table(spark, sf, "tree_docs")).select("raw_id", "ord_path", "title"), "raw_id")
    return p.select("raw_id", "ord_path", F.col("path").alias("navigation_path"))


def t_title_pages(spark, sf):
    return ps.title_pages(_cur(spark, sf).where("granularity = 'pasal'"), _outline_pages(spark, sf))


def x_with_newlines(spark, sf):
    flat = F.regexp_replace("text", "\n", " ")
    return table(spark, sf, "nodes").where("text is not null").select("load_id", F.md5(ps.with_newlines(flat)).alias("text_md5"))


def x_elucidations(spark, sf):
    return ps.elucidations(table(spark, sf, "nodes").where("penjelasan is not null or is_leaf"))


def t_category_leaves(spark, sf):
    return ps.category_leaf_counts(_cur(spark, sf).where("is_leaf").groupBy("doc_id").agg(F.count("*").alias("n")))


def d_parse_errors(spark, sf):
    return ps.parse_errors(_cur(spark, sf))


QUERIES = {
    n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("v_", "a_", "m_", "x_", "t_", "d_") and getattr(f, "__module__", "") == __name__
}

# ---------------------------------------------------------------- SQL

ITEMS = f"""it AS (SELECT *, {GD} AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC) AS rn FROM gt_items WHERE query_id IS NOT NULL) WHERE rn = 1)"""
PAGES = "pg AS (SELECT doc_id, start_index AS page_num, string_agg(text, chr(10) ORDER BY ord_path, load_id) AS raw_text FROM cur WHERE text IS NOT NULL AND start_index IS NOT NULL GROUP BY ALL)"
OPAGES = "pg AS (SELECT doc_id, start_index AS page_num, string_agg(title || chr(10) || coalesce(text, ''), chr(10) ORDER BY ord_path, load_id) AS raw_text FROM cur WHERE granularity = 'pasal' AND title IS NOT NULL AND start_index IS NOT NULL GROUP BY ALL)"
HEADS = "regexp_extract_all(raw_text, '(?m)^\\s*[Pp]asa[l1]\\s+\\d+[A-Z]?\\b')"


def _replaced(c, fixes):
    for pattern, replacement in fixes:
        new = "'" + replacement.replace("$", "\\").replace("\n", "' || chr(10) || '") + "'"
        c = f"regexp_replace({c}, '{pattern}', {new}, 'g')"
    return c


def _summed():
    parts = ["count(*) AS num_queries", "count(*) FILTER (WHERE error <> '') AS error_count"]
    for m in ev.MEASURES:
        v = f"coalesce({m}::DOUBLE, 0)"
        parts += [f"round(avg({v}), 8) AS avg_{m}", f"round(sum({v}), 4) AS total_{m}"]
        parts += [f"round(quantile_cont({v}, {p / 100}::DOUBLE), 6) AS p{p}_{m}" for p in ev.QUANTILES]
    return ", ".join(parts)


REC = f"""{PER_QUERY}, {SIB}, gd AS (SELECT DISTINCT query_id, string_split(item, '/')[1] AS doc FROM gold),
ins AS (SELECT a.query_id, item, rank, row_number() OVER (PARTITION BY a.query_id ORDER BY rank) AS r2 FROM a JOIN gd ON gd.query_id = a.query_id AND gd.doc = string_split(item, '/')[1]),
wh AS (SELECT ins.query_id, count(*) AS n, min(r2) AS fr FROM ins SEMI JOIN gold USING (query_id, item) WHERE r2 <= 10 GROUP BY 1),
pk AS (SELECT query_id, count(*) AS c FROM ins WHERE rank <= 10 GROUP BY 1),
rec AS (SELECT mq.query_id, hit, recall, precision, f1, ndcg, map, mrr, first_rank, coalesce(sibling_hit, 0) AS sibling_hit, CASE WHEN wh.n > 0 THEN 1 ELSE 0 END AS within_doc_hit,
  round(coalesce(wh.n, 0) / n_rel::DOUBLE, 6) AS within_doc_recall, round(CASE WHEN wh.fr IS NOT NULL THEN 1.0::DOUBLE / wh.fr ELSE 0.0::DOUBLE END, 6) AS within_doc_mrr, coalesce(pk.c, 0) AS doc_pick_count,
  CASE WHEN pk.c > 0 THEN 1 ELSE 0 END AS doc_pick_hit, round(coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE), 6) AS full_rr, CASE WHEN first_rank = 1 THEN 1 ELSE 0 END AS top1
  FROM mq JOIN nrel ON nrel.query_id = mq.query_id LEFT JOIN sib ON sib.query_id = mq.query_id LEFT JOIN wh ON wh.query_id = mq.query_id LEFT JOIN pk ON pk.query_id = mq.query_id WHERE k = 10)"""
DESC = f"{REC}, {ITEMS}, de AS (SELECT rec.*, reference_mode, query_style, it.doc_id AS gold_doc, query_type FROM rec JOIN it ON it.query_id = rec.query_id)"
SUMMED = "count(*) AS n, " + ", ".join(f"round(coalesce(avg({m}::DOUBLE), 0), 4) AS {m}" for m in ev.SUMMED) + ", round(coalesce(avg(within_doc_recall) FILTER (WHERE doc_pick_hit > 0), 0), 4)::DOUBLE AS oracle_within_doc_recall, count(first_rank) AS hits_anywhere"

# the ranked list by node ids alone
ZN = f"""{_list("y", "bm25_score")}, a AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY plc) AS rank FROM (SELECT query_id, string_split(item, '/')[-1] AS item, min(rank) AS plc FROM y GROUP BY ALL))"""

ORACLES = {
    "v_chunk_texts": f"""WITH {CUR}, {LEAF} SELECT load_id, md5(text || CASE WHEN penjelasan <> '' AND penjelasan <> 'Cukup jelas.' THEN chr(10) || chr(10) || 'Penjelasan Resmi:' || chr(10) || penjelasan ELSE '' END) AS chunk_md5 FROM leaf""",
    "v_slim_catalog": f"WITH {CUR}, {CATALOG} SELECT reg.doc_id, judul, bentuk_singkat, nullif(substr(coalesce(s, ''), 1, 600), '') AS summary FROM reg LEFT JOIN sums ON sums.doc_id = reg.doc_id",
    "v_outlines": f"""WITH {CUR}, l AS (SELECT granularity, doc_id, ord_path, node_id, repeat('  ', greatest(coalesce(depth, 1) - 1, 0)) || '- [' || node_id || ']' || CASE WHEN trim(coalesce(title, '')) <> '' THEN ' ' || trim(title) ELSE '' END
  || CASE WHEN trim(coalesce(summary, '')) <> '' THEN ' :: ' || trim(summary) ELSE '' END AS line FROM cur)
SELECT granularity, doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY ord_path, node_id, line)) AS outline_md5 FROM l GROUP BY ALL""",
    "v_picked_queries": f"""WITH {ITEMS}, p AS (SELECT query_id, coalesce(nullif(query_type, ''), 'factual') AS query_type, doc_id FROM it), f AS (SELECT * FROM p WHERE query_type IN ('factual', 'paraphrased')),
r AS (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY query_id) AS n FROM f) SELECT query_id, query_type, doc_id FROM r WHERE n <= 20 ORDER BY query_id LIMIT 30""",
    "v_matching": f"WITH {ITEMS} SELECT query_id, doc_id FROM it WHERE contains(lower(doc_id), 'uu') AND contains(lower(query), 'wajib') AND query_type = 'factual'",
    "v_without_preamble": f"""WITH {CUR}, {LEAF}, m AS (SELECT *, NOT regexp_matches(coalesce(navigation_path, ''), 'Menimbang|Mengingat|Menetapkan|Pembukaan') AS body FROM leaf),
b AS (SELECT *, bool_or(body) OVER (PARTITION BY granularity, doc_id) AS any_body FROM m) SELECT granularity, doc_id, node_id FROM b WHERE body OR NOT any_body""",
    "v_anchor_pairs": f"""WITH g AS (SELECT query_id, gold_doc_id, gold_anchor_node_id, coalesce(gold_doc_ids, []) AS ds, coalesce(gold_anchor_node_ids, []) AS an FROM gt_items),
u AS (SELECT query_id, unnest(range(0, greatest(len(an), 1)))::INT AS pos, gold_doc_id, gold_anchor_node_id, ds, an FROM g),
p AS (SELECT DISTINCT query_id, pos, CASE WHEN len(an) > 0 AND len(ds) = len(an) THEN ds[pos + 1] ELSE coalesce(gold_doc_id, ds[1]) END AS d, CASE WHEN len(an) = 0 THEN gold_anchor_node_id ELSE an[pos + 1] END AS a FROM u)
SELECT query_id, pos, {DOC.format(c="d")} AS doc, {NODE.format(c="a")} AS anchor FROM p""",
    "v_defaults": f"WITH {ITEMS} SELECT query_id, " + ", ".join(f"CASE WHEN trim({f}) <> '' THEN {f} ELSE '{v}' END AS {f}" for f, v in (("query_type", "factual"), ("query_style", "formal"), ("reference_mode", "none"), ("gold_anchor_granularity", "pasal"))) + " FROM it",
    "v_payloads": f"""WITH {U} SELECT run_id, coalesce(worker_ok, false) AS ok, CASE WHEN worker_ok IS NULL THEN 'Missing worker payload' WHEN NOT worker_ok THEN coalesce(nullif(error, ''), 'Worker error') ELSE coalesce(error, '') END AS error FROM u""",
    "v_rendered": f"""WITH {CUR}, {LEAF}, s AS (SELECT granularity, doc_id, ord_path, node_id, title, regexp_replace(coalesce(navigation_path, ''), '( > )?[^>]*$', '') AS section FROM leaf),
o AS (SELECT *, coalesce(section <> lag(section) OVER (PARTITION BY granularity, doc_id ORDER BY ord_path, node_id), true) AS opens FROM s)
SELECT granularity, doc_id, sum(opens::INT)::BIGINT AS n_sections, md5(string_agg(CASE WHEN opens THEN '## ' || section || chr(10) ELSE '' END || '- ' || coalesce(title, ''), chr(10) ORDER BY ord_path, node_id)) AS text_md5 FROM o GROUP BY ALL""",
    "v_contexts": f"""WITH {CUR}, k AS (SELECT {DOC.format(c="doc_id")} AS doc_id, {NODE.format(c="node_id")} AS node_id, arg_max(text, load_id) AS text FROM cur WHERE text IS NOT NULL GROUP BY ALL), a AS (SELECT DISTINCT {GD} AS doc_id, {GA} AS node_id FROM gt_items)
SELECT doc_id, node_id, md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || ' ...' ELSE text END) AS context_md5 FROM a JOIN k USING (doc_id, node_id)""",
    "v_sibling_hints": f"""WITH {CUR}, {ITEMS}, c AS (SELECT DISTINCT {DOC.format(c="doc_id")} AS doc_id, {NODE.format(c="node_id")} AS node_id, ord_path FROM cur WHERE granularity = 'pasal'),
w AS (SELECT DISTINCT doc_id, {NODE.format(c="gold_node_id")} AS asked FROM it WHERE doc_id IS NOT NULL), x AS (SELECT w.* FROM w WHERE asked IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.node_id = asked)),
m AS (SELECT x.doc_id, asked, node_id, ord_path, string_split(node_id, '_')[1] = string_split(asked, '_')[1] AS same FROM x JOIN c ON c.doc_id = x.doc_id), y AS (SELECT *, bool_or(same) OVER (PARTITION BY doc_id, asked) AS any_same FROM m)
SELECT * FROM (SELECT doc_id, asked, node_id, row_number() OVER (PARTITION BY doc_id, asked ORDER BY ord_path, node_id)::INT AS rank FROM y WHERE same OR NOT any_same) WHERE rank <= 5""",
    "v_found_nodes": f"""WITH {CUR}, {ITEMS}, c AS (SELECT {DOC.format(c="doc_id")} AS doc_id, {NODE.format(c="node_id")} AS node_id, ord_path, granularity, load_id FROM cur), w AS (SELECT DISTINCT doc_id, {GA} AS node_id FROM it)
SELECT doc_id, node_id, granularity, load_id FROM (SELECT c.*, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY ord_path, granularity, load_id) AS rn FROM c SEMI JOIN w USING (doc_id, node_id)) WHERE rn = 1""",
    "v_catalog_report": f"""WITH r AS (SELECT DISTINCT {DOC.format(c="doc_id")} AS doc_id FROM registry), a AS (SELECT DISTINCT {DOC.format(c="d")} AS doc_id FROM (SELECT unnest(list_concat([gold_doc_id], coalesce(gold_doc_ids, []))) AS d FROM gt_items))
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM r WHERE doc_id IS NOT NULL) THEN 'kept' ELSE 'missing' END AS state FROM a WHERE doc_id IS NOT NULL""",
    "v_missing_files": f"""WITH {CUR}, e AS (SELECT DISTINCT doc_id, g AS granularity FROM registry, (SELECT unnest(['pasal', 'ayat', 'rincian']) AS g) WHERE doc_id IS NOT NULL) SELECT doc_id, granularity FROM e ANTI JOIN cur USING (doc_id, granularity)""",
    "v_targets": "SELECT doc_id, row_number() OVER (ORDER BY doc_id)::INT AS place FROM (SELECT DISTINCT doc_id FROM registry WHERE upper(jenis_folder) = 'PERDA' AND doc_id IS NOT NULL)",
    "v_natural_order": f"""WITH {CUR} SELECT granularity, doc_id, node_id, row_number() OVER (PARTITION BY granularity, doc_id ORDER BY try_cast(nullif(regexp_extract(node_id, 'pasal_([0-9]+)', 1), '') AS INT) NULLS LAST, regexp_extract(node_id, 'pasal_[0-9]+(.*)$', 1), node_id)::INT AS place FROM cur""",
    "v_gold_union": f"""WITH {ITEMS}, e AS (SELECT query_id, doc_id, unnest(list_concat([gold_anchor_node_id], coalesce(gold_anchor_node_ids, []))) AS a FROM it WHERE doc_id IS NOT NULL)
SELECT doc_id, count(DISTINCT query_id) AS n_queries, count(DISTINCT {NODE.format(c="a")}) AS n_anchors FROM e GROUP BY 1""",
    "v_config_drift": f"""WITH {U}, l AS (SELECT DISTINCT system, 'llm_model' AS field, coalesce(llm_model, '') AS v FROM u UNION ALL SELECT DISTINCT system, 'eval_granularity', coalesce(eval_granularity, '') FROM u)
SELECT system, field, count(*) AS n_values, CASE WHEN count(*) > 1 THEN 'differs' ELSE 'same' END AS state FROM l GROUP BY ALL""",
    "v_split_check": "SELECT DISTINCT split_name, split_name <> 'val' AS same FROM gt_splits WHERE split_name IS NOT NULL",
    "a_run_summary": f"WITH {U} SELECT system, eval_granularity, {_summed()} FROM u GROUP BY ALL",
    "a_step_costs": f"""WITH {U}, s AS (SELECT system, coalesce(llm_calls > 0, false) AS m, * EXCLUDE (system) FROM u) SELECT system, CASE WHEN m THEN 'model' ELSE 'total' END AS step, count(*) AS n,
  sum(CASE WHEN m THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) ELSE coalesce(total_tokens, 0) END)::BIGINT AS tokens, round(sum(coalesce(elapsed_s, 0)), 4) AS seconds FROM s GROUP BY ALL""",
    "a_overview": f"""WITH {U}, c AS (SELECT CASE WHEN error <> '' THEN {_error_case()} END AS cls, * FROM u), t AS (SELECT count(*) AS t FROM u),
o AS (SELECT 'combo' AS part, concat_ws('__', system, eval_granularity) AS name, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'overall', '', count(*) FROM u UNION ALL SELECT 'failure', cls, count(*) FROM c WHERE cls IS NOT NULL GROUP BY cls)
SELECT part, name, n, round(n / t::DOUBLE, 6) AS share FROM o, t""",
    "m_records": f"WITH {REC} SELECT * FROM rec",
    "m_by_node_id": "WITH " + PER_QUERY.replace(A, ZN).replace("'/' || node AS item", "node AS item").replace("doc || node AS item", "node AS item") + " SELECT * FROM mq",
    "m_summary": f"WITH {DESC} SELECT query_type, {SUMMED} FROM de GROUP BY 1",
    "m_by_reference_mode": f"WITH {DESC} SELECT reference_mode, {SUMMED} FROM de WHERE reference_mode IN ('none', 'legal_ref', 'doc_only', 'both') GROUP BY 1",
    "m_slices": f"WITH {DESC} " + " UNION ALL ".join(f"SELECT '{n}' AS slice, coalesce({c}, '') AS value, count(*) AS n, round(avg(hit::DOUBLE), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM de GROUP BY ALL" for n, c in (("reference_mode", "reference_mode"), ("query_style", "query_style"), ("gold_doc_id", "gold_doc"), ("query_type", "query_type"))),
    "x_clean_pages": f"WITH {CUR}, {PAGES} SELECT doc_id, page_num, md5(regexp_replace({_replaced('raw_text', ps.PAGE_FIXES + ps.DIGIT_FIXES)}, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pg",
    "x_page_roles": f"""WITH {CUR}, {PAGES}, g AS (SELECT doc_id, max(page_num) AS n_pages, min(page_num) FILTER (WHERE regexp_matches(raw_text, '{ps.CLOSING}')) AS closing_page, min(page_num) FILTER (WHERE regexp_matches(raw_text, '{ps.ELUCIDATION_PAGE}')) AS elucidation_page FROM pg GROUP BY 1)
SELECT *, greatest(coalesce(least(elucidation_page - 1, closing_page), n_pages), 1) AS body_end FROM g""",
    "x_amendments": f"SELECT scrape_id, coalesce(regexp_matches(judul, '{ps.AMENDMENT}'), false) AS is_amendment FROM registry",
    "x_formatted_pages": f"WITH {CUR}, {PAGES}, f AS (SELECT doc_id, count(*) AS n_pages, string_agg('=== PAGE ' || page_num || ' ===' || chr(10) || raw_text, chr(10) ORDER BY page_num) AS t FROM pg GROUP BY 1) SELECT doc_id, n_pages, length(t) AS n_chars, md5(t) AS text_md5 FROM f",
    "x_article_chunks": f"""WITH {CUR}, {OPAGES}, tt AS (SELECT doc_id, max(page_num) AS total FROM pg GROUP BY 1), h AS (SELECT doc_id, page_num, unnest(range(0, len({HEADS}))) AS pos FROM pg),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM h), f AS (SELECT *, i // 5 AS chunk FROM c WHERE n >= 2 AND i % 5 = 0),
s AS (SELECT *, CASE WHEN chunk = 0 THEN 1 ELSE page_num END AS st, lead(page_num) OVER (PARTITION BY doc_id ORDER BY chunk) AS nx FROM f)
SELECT s.doc_id, (chunk + 1)::INT AS chunk_no, greatest(1, st - 1) AS first_page, least(total, coalesce(CASE WHEN nx IS NULL THEN NULL ELSE greatest(st, nx - 1) END, total) + 1) AS last_page FROM s JOIN tt ON tt.doc_id = s.doc_id""",
    "x_chunk_plans": f"""WITH {CUR}, {OPAGES}, g AS (SELECT doc_id, sum(length(raw_text))::BIGINT AS n_chars, sum(len({HEADS}))::BIGINT AS n_articles FROM pg GROUP BY 1)
SELECT *, CASE WHEN n_chars <= 5000 AND n_articles <= 12 THEN 'whole' WHEN n_articles >= 2 THEN 'pasal-aware' ELSE 'page-based' END AS strategy FROM g""",
    "t_title_pages": f"""WITH {CUR}, {OPAGES}, t AS (SELECT granularity, doc_id, node_id, start_index, substr(trim(regexp_replace(title, '\\s+', ' ', 'g')), 1, 40) AS needle FROM cur WHERE granularity = 'pasal')
SELECT t.granularity, t.doc_id, t.node_id, coalesce(min(page_num), min(start_index)) AS found_page FROM t LEFT JOIN pg ON pg.doc_id = t.doc_id AND contains(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), needle) WHERE needle <> '' GROUP BY ALL""",
    "x_with_newlines": "SELECT load_id, md5(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '\\s+(\\(\\d+\\)\\s)', chr(10) || '\\1', 'g'), '(?i)\\b(ayat|pasal|huruf|angka|dan|atau|sampai)\\n', '\\1 ', 'g')) AS text_md5 FROM nodes WHERE text IS NOT NULL",
    "x_elucidations": """WITH r AS (SELECT load_id, coalesce(nullif(trim(penjelasan), ''), 'Cukup jelas.') AS t FROM nodes WHERE load_id IS NOT NULL AND (penjelasan IS NOT NULL OR is_leaf)),
l AS (SELECT load_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM r), o AS (SELECT *, nullif(regexp_extract(line, '^\\s*((?:Ayat \\(\\d+\\))|(?:Huruf [a-z]))\\s*$', 1), '') AS own FROM l),
m AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER w, '') AS label, count(own) OVER w AS part FROM o WINDOW w AS (PARTITION BY load_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT load_id, part, label, md5(string_agg(line, chr(10) ORDER BY pos)) AS told_md5 FROM m WHERE own IS NULL GROUP BY ALL""",
    "t_category_leaves": f"""WITH {CUR}, c AS (SELECT doc_id, count(*) AS n FROM cur WHERE is_leaf GROUP BY 1) SELECT string_split(doc_id, '-')[1] AS folder, count(*) AS n_docs, sum(n)::BIGINT AS total, min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean, floor(quantile_cont(n, 0.5))::BIGINT AS median FROM c GROUP BY 1""",
    "d_parse_errors": f"""WITH {CUR}, r AS (SELECT *, nullif(regexp_extract(node_id, '^pasal_([0-9]+)', 1), '')::INT AS num, len(regexp_extract_all(coalesce(text, ''), '(?m)^\\([0-9]+\\) ')) AS marks FROM cur),
g AS (SELECT granularity, doc_id, count(*) AS n, count(DISTINCT num) AS a, max(num) - min(num) + 1 AS span, count(DISTINCT title) AS titles, count(title) AS titled, count(*) FILTER (WHERE is_leaf AND coalesce(trim(text), '') = '') AS empty, count(*) FILTER (WHERE NOT is_leaf AND marks >= 2) AS hybrid FROM r GROUP BY ALL)
SELECT granularity, doc_id, unnest(list_filter([CASE WHEN a = 0 THEN 'no_articles' END, CASE WHEN span > a THEN 'missing_articles' END, CASE WHEN (titled - titles) * 20 > n THEN 'doubled_titles' END, CASE WHEN empty > greatest(5, n // 10) THEN 'empty_leaves' END, CASE WHEN hybrid > 0 THEN 'hybrid_node' END], lambda x: x IS NOT NULL)) AS error FROM g""",
}
