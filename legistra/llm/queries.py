"""The queries of the training-data operators, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from legistra.llm import contamination, cross_split, fusion, languages, packing, quantiles, scans, splits
from legistra.llm.lexicons import INDONESIAN
from legistra.plans.corpus import DOC
from legistra.sources.tables import table


def p1_found(spark, sf):
    return splits.related_groups(table(spark, sf, "gt_items")).select("query_id", "group_doc")


def p1_splits(spark, sf):
    return splits.assign_splits(splits.related_groups(table(spark, sf, "gt_items")))


def p1_report(spark, sf):
    return splits.split_report(p1_splits(spark, sf))


def p2_found(spark, sf):
    return cross_split.cross_split_pairs(table(spark, sf, "gt_items"), table(spark, sf, "gt_splits"), INDONESIAN)


def p2_report(spark, sf):
    return cross_split.overlap_report(p2_found(spark, sf), table(spark, sf, "gt_items"), table(spark, sf, "gt_splits"))


def p4_found(spark, sf):
    return scans.scan_findings(table(spark, sf, "nodes"))


def p4_paragraphs(spark, sf):
    return scans.repaired_paragraphs(table(spark, sf, "nodes"))


def p6_found(spark, sf):
    return fusion.first_of_each(fusion.fused(table(spark, sf, "retrieved")))


def p6_ranking(spark, sf):
    return fusion.fused_ranking(table(spark, sf, "retrieved"))


def p7_found(spark, sf):
    return quantiles.outlying_runs(table(spark, sf, "query_runs"))


def p7_percentiles(spark, sf):
    p = quantiles.run_percentiles(table(spark, sf, "query_runs"))
    return p.withColumn("estimate", F.round("estimate", 6))


def p8_containers(spark, sf):
    return packing.packed(table(spark, sf, "documents"), table(spark, sf, "pack_targets"))


def p8_report(spark, sf):
    return packing.fill_report(p8_containers(spark, sf), table(spark, sf, "pack_targets"))


def p9_found(spark, sf):
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_report(spark, sf):
    return contamination.leak_report(p9_found(spark, sf))


def p10_found(spark, sf):
    segs = languages.language_segments(table(spark, sf, "documents"), table(spark, sf, "lang_samples"), only_cases=True)
    return segs.select("doc_id", "seg_no", "lang")


def p10_segments(spark, sf):
    return languages.language_segments(table(spark, sf, "documents"), table(spark, sf, "lang_samples"))


def p10_documents(spark, sf):
    return languages.relabelled(table(spark, sf, "documents"), table(spark, sf, "lang_samples"))


_ALL = [p1_found, p1_splits, p1_report, p2_found, p2_report, p4_found, p4_paragraphs, p6_found, p6_ranking, p7_found, p7_percentiles, p8_containers, p8_report, p9_found, p9_report, p10_found, p10_segments, p10_documents]

FUSED = """
WITH c AS (SELECT DISTINCT query_id, cand_id, bm25_score::DOUBLE AS s1, dense_score::DOUBLE AS s2, llm_score::DOUBLE AS s3, -rerank_position::DOUBLE AS s4 FROM retrieved),
r AS (
  SELECT query_id, cand_id,
    CASE WHEN s1 IS NULL OR isnan(s1) THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(s1) THEN NULL ELSE s1 END DESC NULLS LAST)) END AS b1,
    CASE WHEN s2 IS NULL OR isnan(s2) THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(s2) THEN NULL ELSE s2 END DESC NULLS LAST)) END AS b2,
    CASE WHEN s3 IS NULL OR isnan(s3) THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(s3) THEN NULL ELSE s3 END DESC NULLS LAST)) END AS b3,
    CASE WHEN s4 IS NULL OR isnan(s4) THEN 0 ELSE 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(s4) THEN NULL ELSE s4 END DESC NULLS LAST)) END AS b4
  FROM c),
t AS (SELECT query_id, cand_id, 0.0::DOUBLE + b1 + b2 + b3 + b4 AS total FROM r)
"""

_VALUES = "\nUNION ALL\n".join(
    f"SELECT run_id, system, eval_granularity, '{m}' AS metric, {m}::DOUBLE AS value FROM runs WHERE {m} >= 0 AND NOT isnan({m}::DOUBLE)"
    for m in ("elapsed_s", "total_tokens", "llm_calls")
)

_ORACLES = {
    "p6_found": FUSED + "SELECT query_id, arg_max(cand_id, (round(total, 12), -cand_id)) AS cand_id FROM t GROUP BY query_id",
    "p6_ranking": FUSED + "SELECT query_id, cand_id, round(total, 9) AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 12) DESC, cand_id) AS position FROM t",
    "p7_found": f"""
WITH runs AS (SELECT * FROM query_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at, started_at) = 1),
v AS ({_VALUES}),
m AS (SELECT system, eval_granularity, metric, median(value) AS med FROM v GROUP BY ALL)
SELECT run_id, v.metric FROM v JOIN m ON v.system IS NOT DISTINCT FROM m.system
  AND v.eval_granularity IS NOT DISTINCT FROM m.eval_granularity AND v.metric = m.metric
WHERE value > 3 * med""",
    "p7_percentiles": f"""
WITH runs AS (SELECT * FROM query_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at, started_at) = 1),
v AS ({_VALUES}),
b AS (SELECT system, eval_granularity, metric, CASE WHEN value < 1e-300 THEN 0 ELSE 1 END AS sign,
  CASE WHEN value < 1e-300 THEN 0 ELSE ceil(ln(value) / ln(1.01::DOUBLE / 0.99::DOUBLE)) END AS bucket FROM v),
c AS (SELECT *, count(*) AS n FROM b GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY system, eval_granularity, metric ORDER BY sign, bucket) AS upto, sum(n) OVER (PARTITION BY system, eval_granularity, metric) AS total FROM c)
SELECT system, eval_granularity, metric, q, total::BIGINT AS total, round(sign * 2.0::DOUBLE * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) / (1.01::DOUBLE / 0.99::DOUBLE + 1), 6) AS estimate
FROM o, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q) WHERE upto > floor(q * (total - 1)) AND upto - n <= floor(q * (total - 1))""",
    "p1_found": f"""
WITH RECURSIVE r AS (SELECT DISTINCT query_id, nullif(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '') AS qk,
  list_filter(list_transform(list_concat([gold_doc_id], coalesce(gold_doc_ids, [])), lambda x: {DOC.format(c="x")}), lambda x: x IS NOT NULL) AS ds FROM gt_items),
k AS (SELECT query_id, 'd:' || unnest(ds) AS v FROM r UNION SELECT query_id, 'q:' || qk FROM r WHERE qk IS NOT NULL UNION SELECT query_id, 'r:' || coalesce(query_id::VARCHAR, '') FROM r),
h AS (SELECT query_id, min(v) AS hub FROM k GROUP BY 1),
e AS (SELECT DISTINCT hub AS a, v AS b FROM h JOIN k ON h.query_id IS NOT DISTINCT FROM k.query_id WHERE hub <> v),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(v, x) AS (SELECT DISTINCT v, v FROM k UNION SELECT s.b, w.x FROM w JOIN s ON s.a = w.v),
g AS (SELECT v, min(CASE WHEN starts_with(x, 'd:') THEN substr(x, 3) END) AS group_doc FROM w GROUP BY 1)
SELECT query_id, min(group_doc) AS group_doc FROM h JOIN g ON g.v = h.hub GROUP BY 1""",
}


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    return dict(_ORACLES)
