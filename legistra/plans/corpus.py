"""Queries on nested records (problem 3) and orphan references (problem 5)."""

from __future__ import annotations

from legistra.operators import nested, orphans
from legistra.sources.tables import table


def p3_found(spark, sf):
    return nested.node_table(table(spark, sf, "tree_docs")).select("raw_id", "ord_path", "parent_path", "node_id")


def p3_relations(spark, sf):
    return nested.relation_table(table(spark, sf, "tree_docs"))


def p3_navigation(spark, sf):
    return nested.navigation_table(table(spark, sf, "tree_docs"))


def p5_found(spark, sf):
    return orphans.corpus_orphans(table(spark, sf, "gt_items"), table(spark, sf, "nodes"), table(spark, sf, "registry"))


def p5_report(spark, sf):
    return orphans.orphan_report(p5_found(spark, sf))


QUERIES = {f.__name__: f for f in (p3_found, p3_relations, p3_navigation, p5_found, p5_report)}

DOC = "nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '\\.(json|pdf|txt|xml|html?|docx?|md)$', ''), '[\\s_\\-]+', '-', 'g')), '^-+|-+$', '', 'g')), '')"
NODE = "nullif(regexp_replace(trim(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '^.*/', '')), '[\\s\\-]+', '_', 'g'), '')"
NUMBER = "nullif(regexp_replace(regexp_replace({c}, '\\s+', '', 'g'), '^0+(.)', '\\1'), '')"

P5_FOUND = f"""
WITH items AS (
  SELECT query_id, created_at, gold_node_id, gold_anchor_node_id, lower(trim(gold_anchor_granularity)) AS g,
         coalesce({DOC.format(c="gold_doc_id")}, {DOC.format(c="gold_doc_ids[1]")}, '') AS doc
  FROM gt_items),
refs AS (
  SELECT 'gt_items' AS src_table, query_id AS src_id, 'gold_node_id' AS field_name, {NODE.format(c="gold_node_id")} AS ref_key,
         'pasal|' || doc || '|' || {NODE.format(c="gold_node_id")} AS k, created_at AS t FROM items
  UNION
  SELECT 'gt_items', query_id, 'gold_anchor_node_id', {NODE.format(c="gold_anchor_node_id")},
         coalesce(g, '') || '|' || doc || '|' || {NODE.format(c="gold_anchor_node_id")}, created_at FROM items
  UNION
  SELECT 'registry', scrape_id, 'ref_id', {NUMBER.format(c="r.ref_id")}, 'R|' || {NUMBER.format(c="r.ref_id")}, scraped_at
  FROM (SELECT scrape_id, scraped_at, unnest(relasi) AS r FROM registry)),
targets AS (
  SELECT lower(trim(granularity)) || '|' || {DOC.format(c="doc_id")} || '|' || {NODE.format(c="node_id")} AS k, loaded_at AS a, deleted_at AS b FROM nodes
  UNION ALL
  SELECT 'R|' || {NUMBER.format(c="detail_id")}, scraped_at, removed_at FROM registry),
judged AS (
  SELECT src_table, src_id, field_name, ref_key, refs.t, count(targets.k) AS n,
         count(*) FILTER (WHERE targets.k IS NOT NULL AND a <= refs.t) AS started,
         count(*) FILTER (WHERE targets.k IS NOT NULL AND a <= refs.t AND (b IS NULL OR b > refs.t)) AS alive
  FROM refs LEFT JOIN targets ON refs.k = targets.k
  WHERE ref_key IS NOT NULL
  GROUP BY ALL)
SELECT DISTINCT src_table, src_id, field_name, ref_key,
       CASE WHEN n = 0 THEN 'missing' WHEN started = 0 THEN 'late' ELSE 'deleted' END AS reason,
       strftime(t, '%Y-%m') AS period
FROM judged WHERE alive = 0
"""

ORACLES = {
    "p5_found": P5_FOUND,
    "p5_report": f"""SELECT src_table, field_name, reason, period, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys
FROM ({P5_FOUND}) GROUP BY ALL""",
}
