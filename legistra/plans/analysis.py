"""Queries on trees, texts, runs, samples and the quality of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from legistra.functions.ids import canonical_doc, canonical_node, gold_doc
from legistra.operators import corpus_tables as ct
from legistra.operators import provisions as pv
from legistra.operators import quality as dq
from legistra.operators import statistics as st
from legistra.operators import summaries as sm
from legistra.operators import text as tx
from legistra.plans.corpus import DOC, NODE
from legistra.plans.search import CUR, LEAF
from legistra.sources.tables import table


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


_nodes, _runs, _gt, _reg = _t("nodes"), _t("query_runs"), _t("gt_items"), _t("registry")


def _cur(spark, sf):
    return ct.current_nodes(_nodes(spark, sf))


# ---------------------------------------------------------------- trees


def t_current(spark, sf):
    return _cur(spark, sf).select("granularity", "doc_id", "node_id", "load_id")


def t_preorder(spark, sf):
    return ct.preorder(_cur(spark, sf)).select("granularity", "doc_id", "node_id", "depth", "position")


def t_navigation_check(spark, sf):
    return ct.navigation_check(_cur(spark, sf))


def t_page_bounds(spark, sf):
    return ct.page_bounds_broken(_cur(spark, sf))


def t_duplicate_loads(spark, sf):
    return ct.duplicate_loads(_nodes(spark, sf))


def t_leaf_counts(spark, sf):
    return ct.leaf_counts(_cur(spark, sf))


def t_granularity_suspects(spark, sf):
    return ct.granularity_suspects(_cur(spark, sf))


def t_leaf_lengths(spark, sf):
    return ct.leaf_lengths(_cur(spark, sf))


def t_depth_branching(spark, sf):
    return ct.depth_and_branching(_cur(spark, sf))


def t_rollup_text(spark, sf):
    return ct.rolled_up(_cur(spark, sf))


def t_ancestors(spark, sf):
    return ct.ancestors(_cur(spark, sf))


def t_parent_check(spark, sf):
    """Nodes whose stored parent is not the one their id names."""
    c = _cur(spark, sf).withColumn("named", ct.parent_prefix(F.col("node_id")))
    return c.where(F.coalesce("parent_id", F.lit("")) != F.col("named")).select("granularity", "doc_id", "node_id", F.coalesce("parent_id", F.lit("")).alias("stored"), "named")


def t_canonical_titles(spark, sf):
    return _cur(spark, sf).select("granularity", "doc_id", "node_id", ct.canonical_title(F.col("node_id")).alias("canonical"))


def t_gold_rollup(spark, sf):
    """The article leaf that each gold anchor rolls up to."""
    c = _cur(spark, sf).withColumn("doc_id", canonical_doc(F.col("doc_id"))).withColumn("node_id", canonical_node(F.col("node_id")))
    a = _gt(spark, sf).select(gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")).alias("doc_id"), canonical_node(F.col("gold_anchor_node_id")).alias("node_id"))
    return ct.nearest_leaf(a.where("doc_id is not null and node_id is not null"), c, "pasal")


# ---------------------------------------------------------------- texts


def _texts(spark, sf):
    return _nodes(spark, sf).where("text is not null").select("load_id", "text")


def x_markers(spark, sf):
    return tx.markers(_texts(spark, sf), "load_id", "text")


def x_split_clauses(spark, sf):
    return tx.split_at_markers(_texts(spark, sf), "load_id", "text")


def x_numbering_gaps(spark, sf):
    return tx.numbering_gaps(x_markers(spark, sf), "load_id")


def x_page_chunks(spark, sf):
    return tx.page_chunks(_t("tree_docs")(spark, sf), "raw_id", "total_pages")


def x_reference_mode(spark, sf):
    g = _gt(spark, sf).where("query is not null").select("query_id", "query", "reference_mode").distinct()
    return g.groupBy(tx.reference_mode(F.col("query")).alias("inferred"), "reference_mode").agg(F.count_distinct("query_id").alias("n"))


def x_slugs(spark, sf):
    return _reg(spark, sf).where("judul is not null").select("scrape_id", tx.slug(F.col("judul")).alias("slug"))


def x_content_words(spark, sf):
    g = _gt(spark, sf).where("query is not null").select("query_id", "query").distinct()
    return g.select("query_id", F.array_join(tx.content_words(F.col("query")), " ").alias("words"))


def x_paraphrase_overlap(spark, sf):
    doc, node = gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")), canonical_node(F.col("gold_anchor_node_id"))
    q = _gt(spark, sf).where("query_type = 'paraphrased'").select("query_id", "query", doc.alias("doc_id"), node.alias("node_id")).distinct()
    leaf = _cur(spark, sf).select(canonical_doc(F.col("doc_id")).alias("doc_id"), canonical_node(F.col("node_id")).alias("node_id"), "text", "load_id").where("text is not null")
    one = leaf.groupBy("doc_id", "node_id").agg(F.max_by("text", "load_id").alias("text"))
    return tx.paraphrase_overlap(q, one)


def x_cleaning_gate(spark, sf):
    """Whether the text of a reload may replace that of the load before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("granularity", "doc_id", "node_id").orderBy("loaded_at", "load_id")
    n = _nodes(spark, sf).where("node_id is not null").withColumn("old", F.lag("text").over(w)).withColumn("nth", F.row_number().over(w))
    return n.where("nth > 1").select("load_id", tx.cleaning_accepted(F.col("old"), F.col("text")).alias("accepted"))


# ---------------------------------------------------------------- runs


def a_combo_summary(spark, sf):
    return sm.combo_summary(_runs(spark, sf))


def a_slices(spark, sf):
    return sm.slices(_runs(spark, sf), _gt(spark, sf))


def a_totals(spark, sf):
    return sm.totals(_runs(spark, sf))


def a_percentiles(spark, sf):
    return sm.interpolated_percentiles(_runs(spark, sf))


def a_nearest_percentiles(spark, sf):
    return sm.nearest_percentiles(_runs(spark, sf))


def a_error_classes(spark, sf):
    return sm.errors_by_class(_runs(spark, sf))


def a_retry_plan(spark, sf):
    return sm.retry_plan(_runs(spark, sf))


def a_token_cost(spark, sf):
    return sm.token_cost(_runs(spark, sf), spark.createDataFrame(list(sm.PRICES), "llm_model string, input_price double, output_price double"))


def a_cost_by_style(spark, sf):
    return sm.cost_by_style(_runs(spark, sf), _gt(spark, sf))


def a_repeats(spark, sf):
    return sm.retries(_runs(spark, sf))


def a_gt_statistics(spark, sf):
    return sm.gt_statistics(_gt(spark, sf))


def a_type_by_mode(spark, sf):
    return sm.type_by_mode(_gt(spark, sf))


def a_fingerprints(spark, sf):
    return sm.fingerprints(_t("gt_splits")(spark, sf))


def a_corpus_status(spark, sf):
    return sm.corpus_status(_reg(spark, sf), _nodes(spark, sf), _t("tree_docs")(spark, sf))


# ---------------------------------------------------------------- quality


def d_gt_errors(spark, sf):
    return dq.gt_errors(_gt(spark, sf), _cur(spark, sf))


def d_collected(spark, sf):
    return dq.collected(_gt(spark, sf))


def d_quality_scores(spark, sf):
    return dq.quality_scores(_nodes(spark, sf))


def d_eligibility(spark, sf):
    return dq.eligibility(_reg(spark, sf), _nodes(spark, sf))


def d_stale(spark, sf):
    return dq.stale(_reg(spark, sf), _nodes(spark, sf))


def d_resume(spark, sf):
    return dq.to_resume(_gt(spark, sf), _runs(spark, sf), "llm_agent")


def d_mirror(spark, sf):
    return dq.mirror_actions(_reg(spark, sf), _nodes(spark, sf), "doc_id")


def d_registry_upsert(spark, sf):
    return ct.newest(_reg(spark, sf).where("doc_id is not null"), ["doc_id"], ["scraped_at", "scrape_id"]).select("doc_id", "scrape_id", "status")


# ---------------------------------------------------------------- statistics


def _pairs(spark, sf):
    return st.paired(_runs(spark, sf), "hybrid_flat", "llm_flat")


def s_paired(spark, sf):
    return _pairs(spark, sf).select("query_id", "eval_granularity", F.round("va", 6).alias("va"), F.round("vb", 6).alias("vb"))


def s_paired_test(spark, sf):
    return st.paired_test(_pairs(spark, sf))


def s_bootstrap_hash(spark, sf):
    ok = sm.unique_runs(_runs(spark, sf)).where("elapsed_s >= 0").select("run_id", "system", F.col("elapsed_s").alias("v"))
    return st.bootstrap_hash(ok, "run_id", "system", "v", 100)


def s_bootstrap_seeded(spark, sf):
    pairs = _pairs(spark, sf).select("eval_granularity", (F.col("va") - F.col("vb")).alias("d"))
    return st.bootstrap_seeded(pairs, "eval_granularity", "d")


def s_randomization_hash(spark, sf):
    return st.randomization_hash(_pairs(spark, sf), "query_id")


def s_hamilton(spark, sf):
    g = _gt(spark, sf).groupBy("query_type").agg(F.count_distinct("query_id").alias("t"))
    return st.largest_remainder(g, "query_type", "t", [("dev", 0.4), ("val", 0.3), ("test", 0.3)])


def s_stratified_pick(spark, sf):
    n = _cur(spark, sf).where("is_leaf").groupBy("doc_id").agg(F.count("*").alias("leaf_count"))
    d = n.withColumn("folder", F.split("doc_id", "-")[0])
    return st.stratified_pick(d, "folder", "doc_id", "leaf_count", 5)


def s_cells(spark, sf):
    doc = F.split(gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")), "-")[0]
    c = _gt(spark, sf).groupBy(F.coalesce(doc, F.lit("")).alias("folder"), "query_type").agg(F.count_distinct("query_id").alias("n"))
    return st.cell_allocation(c, ["folder", "query_type"], "n")


def s_adaptive_n(spark, sf):
    n = _cur(spark, sf).where("is_leaf").groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", "n", F.when(F.col("n") < 5, 0).otherwise(F.least("n", F.lit(5))).cast("bigint").alias("quota"))


def s_greedy_parts(spark, sf):
    n = _cur(spark, sf).where("is_leaf and text is not null").select("doc_id", F.concat_ws("|", "granularity", "ord_path", "node_id").alias("o"), F.length("text").alias("len"))
    return st.greedy_parts(n, "doc_id", "o", "len", 2000)


def s_pricing(spark, sf):
    """The star schema's pricing summary, by return flag and line status."""
    x = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(paid), 2).alias("revenue"))


def s_nation_revenue(spark, sf):
    """Revenue per nation, over four joined tables."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


def s_event_windows(spark, sf):
    """Events an hour and type, with the mean value."""
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def x_deep_split(spark, sf):
    return pv.deep_split(_texts(spark, sf), "load_id", "text")


def x_headings(spark, sf):
    """Texts with the scanner's errors in headings and item numbers mended."""
    return _texts(spark, sf).select("load_id", F.md5(pv.fixed_heading(F.col("text"))).alias("text_md5"))


def d_document_checks(spark, sf):
    return pv.document_checks(_cur(spark, sf))


def t_page_ends(spark, sf):
    return pv.page_ends(_cur(spark, sf))


def d_review_states(spark, sf):
    return pv.review_states(_nodes(spark, sf), _gt(spark, sf), _t("gt_splits")(spark, sf))


def a_repeated_actions(spark, sf):
    return pv.repeated_actions(sm.unique_runs(_runs(spark, sf)))


def s_quotas(spark, sf):
    n = _cur(spark, sf).where("is_leaf").groupBy("doc_id").agg(F.count("*").alias("leaves"))
    return pv.proportional_quotas(n.withColumn("folder", F.split("doc_id", "-")[0]), "folder", "doc_id", "leaves", 100)


QUERIES = {
    n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("t_", "x_", "a_", "d_", "s_") and getattr(f, "__module__", "") == __name__
}

# ---------------------------------------------------------------- SQL

U = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC, started_at DESC) AS rn FROM query_runs WHERE run_id IS NOT NULL) WHERE rn = 1)"
REG = "reg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY scraped_at DESC, scrape_id DESC) AS rn FROM registry WHERE doc_id IS NOT NULL) WHERE rn = 1)"
K = "granularity, doc_id, node_id"
LC = "lc AS (SELECT doc_id, count(*) FILTER (WHERE granularity = 'pasal') AS pasal, count(*) FILTER (WHERE granularity = 'ayat') AS ayat, count(*) FILTER (WHERE granularity = 'rincian') AS rincian FROM cur WHERE is_leaf GROUP BY 1)"
NAMED = "CASE WHEN len(string_split(node_id, '_')) < 4 THEN '' ELSE array_to_string(string_split(node_id, '_')[1:len(string_split(node_id, '_')) - 2], '_') END"
LINES = "ln AS (SELECT load_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM nodes WHERE text IS NOT NULL)"
MARK = LINES + """,
mk AS (SELECT load_id, pos, line, lower(regexp_extract(trim(coalesce(lag(line) OVER (PARTITION BY load_id ORDER BY pos), '')), '([A-Za-z]+)$', 1)) AS before,
  CASE WHEN regexp_matches(line, '^\\([0-9]+[a-z]?\\) ') THEN 'ayat' WHEN regexp_matches(line, '^[a-z]\\. ') THEN 'huruf' WHEN regexp_matches(line, '^[0-9]+\\. ') THEN 'angka' END AS kind,
  regexp_extract(line, '^\\(?([0-9]+[a-z]?|[a-z])[.)] ', 1) AS label FROM ln),
found AS (SELECT load_id, pos AS line_no, kind, label FROM mk WHERE kind IS NOT NULL AND before NOT IN ('ayat', 'pasal', 'huruf', 'angka', 'dan', 'atau', 'sampai'))"""
GD = f"coalesce({DOC.format(c='gold_doc_id')}, {DOC.format(c='gold_doc_ids[1]')})"
GA = NODE.format(c="gold_anchor_node_id")
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _content(c):
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP}))))"


PAIRS = f"""{U}, pr AS (SELECT query_id, eval_granularity, avg(elapsed_s) FILTER (WHERE system = 'hybrid_flat') AS va, avg(elapsed_s) FILTER (WHERE system = 'llm_flat') AS vb
  FROM u WHERE coalesce(error, '') = '' AND elapsed_s >= 0 AND query_id IS NOT NULL GROUP BY ALL HAVING va IS NOT NULL AND vb IS NOT NULL)"""


def _error_case():
    out = "'other'"
    for name, parts in reversed(sm.ERROR_CLASSES):
        cond = " OR ".join("(" + " AND ".join(f"contains(lower(error), '{x}')" for x in p.split("&")) + ")" for p in parts)
        out = f"CASE WHEN {cond} THEN '{name}' ELSE {out} END"
    return out


def _label(d):
    out = "'huge'"
    for bound, name in reversed(st.BANDS):
        out = f"CASE WHEN abs({d}) < {bound} THEN '{name}' ELSE {out} END"
    return out


def _poisson():
    import math

    parts, cumulative, term = [], 0.0, math.exp(-1)
    for k in range(1, st.POISSON_STEPS + 1):
        cumulative += term
        term /= k
        parts.append(f"CASE WHEN uu >= {round(cumulative, 12)}::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(parts)


QUAL = f"""{CUR}, qx AS (SELECT doc_id, count(DISTINCT node_id) AS expected FROM nodes WHERE granularity = 'pasal' AND doc_id IS NOT NULL AND regexp_matches(node_id, '^pasal_[0-9]+') GROUP BY 1),
qn AS (SELECT *, nullif(regexp_extract(node_id, '^pasal_([0-9]+)', 1), '')::INT AS num, trim(coalesce(text, '')) AS tx, trim(coalesce(title, '')) AS ti FROM cur WHERE granularity = 'pasal'),
qm AS (SELECT *, num < lag(num) OVER (PARTITION BY doc_id ORDER BY ord_path, node_id) AS falls, is_leaf AND regexp_matches(ti, '^Pasal\\s+\\d') AND (length(tx) < 30 OR tx = ti) AS empty,
  is_leaf AND coalesce(regexp_matches(text, '(?m)\\n\\s*Pasal\\s+\\d+[A-Z]?\\s*$'), false) AS bleeds, is_leaf AND (len(list_distinct(regexp_extract_all(coalesce(text, ''), '(?m)^\\((\\d+)\\)\\s', 1))) >= 2
  OR len(list_distinct(regexp_extract_all(coalesce(text, ''), '(?m)^([a-z])\\.\\s', 1))) >= 3 OR len(list_distinct(regexp_extract_all(coalesce(text, ''), '(?m)^(\\d+)\\.\\s', 1))) >= 3) AS unsplit FROM qn),
ql AS (SELECT doc_id, count(DISTINCT node_id) AS actual, count(DISTINCT num) AS n_articles, coalesce(max(num) - min(num) + 1 - count(DISTINCT num), 0) AS gaps, count(*) FILTER (WHERE falls) AS falls, count(*) FILTER (WHERE empty) AS empty,
  count(*) FILTER (WHERE bleeds) AS bleeds, count(*) FILTER (WHERE unsplit) AS unsplit FROM qm GROUP BY 1),
qs AS (SELECT ql.doc_id, n_articles, greatest(0.0::DOUBLE, round(100.0::DOUBLE * least(1.0::DOUBLE, coalesce(actual / expected::DOUBLE, 1.0::DOUBLE)) - CASE WHEN falls > 0 THEN 15 ELSE 0 END - least(15, 2 * gaps) - least(20, 5 * bleeds)
  - least(25, 8 * empty) - least(10, unsplit), 1)) AS score FROM ql LEFT JOIN qx ON qx.doc_id = ql.doc_id),
qv AS (SELECT doc_id, n_articles, score, CASE WHEN score >= 90 THEN 'OK' WHEN score >= 70 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM qs)"""
SHARES = "(VALUES (0, 'dev', 0.4::DOUBLE), (1, 'val', 0.3::DOUBLE), (2, 'test', 0.3::DOUBLE)) AS p(i, part, share)"

LN_DEEP = f"""WITH {LINES}, m AS (SELECT *, nullif(regexp_extract(line, '^\\(([0-9]+)\\) ', 1), '') AS a, nullif(regexp_extract(line, '^([a-z])\\. ', 1), '') AS h FROM ln),
p AS (SELECT *, (count(a) OVER (PARTITION BY load_id ORDER BY pos))::BIGINT AS part FROM m),
l AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER w, '') AS ayat, coalesce(last_value(h IGNORE NULLS) OVER w, '') AS huruf FROM p WINDOW w AS (PARTITION BY load_id, part ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT load_id, part, ayat, huruf, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM l GROUP BY ALL"""


def _headings(c):
    for pattern, replacement in pv.HEADING_FIXES:
        c = f"regexp_replace({c}, '{pattern}', '{replacement.replace('${1}', '$1').replace('$', chr(92))}', 'g')"
    return c


ORACLES = {
    "t_current": f"WITH {CUR} SELECT {K}, load_id FROM cur",
    "t_preorder": f"WITH {CUR} SELECT {K}, depth, row_number() OVER (PARTITION BY granularity, doc_id ORDER BY ord_path, node_id)::INT AS position FROM cur",
    "t_navigation_check": f"WITH {CUR} SELECT {K}, navigation_path AS stored, title AS expected_end FROM cur WHERE coalesce(string_split(navigation_path, ' > ')[-1] <> title, true)",
    "t_page_bounds": f"WITH {CUR} SELECT {K}, start_index, end_index FROM cur WHERE start_index > end_index",
    "t_duplicate_loads": "SELECT granularity, doc_id, count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes, count(*) - count(DISTINCT node_id) AS n_surplus FROM nodes GROUP BY ALL",
    "t_leaf_counts": f"WITH {CUR}, {LC} SELECT * FROM lc",
    "t_granularity_suspects": f"WITH {CUR}, {LC} SELECT * FROM lc WHERE (pasal > ayat AND ayat > 0) OR (ayat > rincian AND rincian > 0)",
    "t_leaf_lengths": f"""WITH {CUR}, {LEAF}, r AS (SELECT granularity, length(text) AS size, row_number() OVER (PARTITION BY granularity ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY granularity) AS n FROM leaf)
SELECT granularity, count(*) AS n, round(avg(size))::BIGINT AS mean_chars, max(size) FILTER (WHERE i = floor(n * 0.5::DOUBLE)) AS p50, max(size) FILTER (WHERE i = floor(n * 0.95::DOUBLE)) AS p95, max(size) FILTER (WHERE i = floor(n * 0.99::DOUBLE)) AS p99, max(size) AS longest,
  round(100 * avg(CASE WHEN size > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 1) AS over_5000_percent, round(100 * avg(CASE WHEN size > 10000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 1) AS over_10000_percent FROM r GROUP BY 1""",
    "t_depth_branching": f"WITH {CUR}, p AS (SELECT granularity, doc_id, depth, count(*) AS n FROM cur GROUP BY ALL) SELECT granularity, depth, sum(n)::BIGINT AS n_nodes, count(*) AS n_docs, round(avg(n), 6) AS mean_branching, max(n) AS most FROM p GROUP BY ALL",
    "t_rollup_text": f"""WITH {CUR}, {LEAF}, r AS (SELECT doc_id, regexp_extract(node_id, '^(.*?pasal_[0-9A-Za-z]+)', 1) AS pasal, ord_path, node_id, text FROM leaf WHERE granularity = 'rincian'),
g AS (SELECT doc_id, pasal, count(*) AS n_leaves, string_agg(text, chr(10) ORDER BY ord_path, node_id, text) AS t FROM r WHERE pasal <> '' GROUP BY ALL) SELECT doc_id, pasal, n_leaves, length(t) AS n_chars, md5(t) AS text_md5 FROM g""",
    "t_ancestors": f"""WITH {CUR} SELECT c.granularity, c.doc_id, c.node_id, a.node_id AS ancestor_id, ((len(string_split(c.node_id, '_')) - len(string_split(a.node_id, '_'))) / 2)::INT AS distance
FROM cur c JOIN cur a ON a.granularity = c.granularity AND a.doc_id = c.doc_id AND starts_with(c.node_id, a.node_id || '_')""",
    "t_parent_check": f"WITH {CUR} SELECT {K}, coalesce(parent_id, '') AS stored, {NAMED} AS named FROM cur WHERE coalesce(parent_id, '') <> {NAMED}",
    "t_canonical_titles": f"""WITH {CUR} SELECT {K}, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(node_id, '(pasal_[0-9A-Za-z]+(?:_(?:ayat|huruf|angka)_[0-9A-Za-z]+)*)$', 1),
  'pasal_([0-9]+[A-Za-z]?)', 'Pasal \\1', 'g'), '_ayat_([0-9A-Za-z]+)', ' Ayat (\\1)', 'g'), '_huruf_([0-9A-Za-z]+)', ' Huruf \\1', 'g'), '_angka_([0-9A-Za-z]+)', ' Angka \\1', 'g') AS canonical FROM cur""",
    "t_gold_rollup": f"""WITH {CUR}, {LEAF}, a AS (SELECT DISTINCT {GD} AS doc_id, {GA} AS node_id FROM gt_items), l AS (SELECT DISTINCT {DOC.format(c="doc_id")} AS doc_id, {NODE.format(c="node_id")} AS leaf_id FROM leaf WHERE granularity = 'pasal')
SELECT a.doc_id, a.node_id, arg_max(leaf_id, length(leaf_id)) AS leaf_id FROM a JOIN l ON l.doc_id = a.doc_id AND (a.node_id = l.leaf_id OR starts_with(a.node_id, l.leaf_id || '_')) GROUP BY ALL""",
    "x_markers": f"WITH {MARK} SELECT * FROM found",
    "x_split_clauses": f"""WITH {LINES}, p AS (SELECT load_id, pos, line, sum(CASE WHEN regexp_matches(line, '^\\([0-9]+\\) ') THEN 1 ELSE 0 END) OVER (PARTITION BY load_id ORDER BY pos)::BIGINT AS part FROM ln),
g AS (SELECT load_id, part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS t FROM p GROUP BY ALL) SELECT load_id, part, regexp_extract(t, '^\\(([0-9]+)\\) ', 1) AS label, n_lines, md5(t) AS text_md5 FROM g""",
    "x_numbering_gaps": f"""WITH {MARK}, n AS (SELECT DISTINCT load_id, regexp_extract(label, '([0-9]+)', 1)::INT AS n FROM found WHERE kind = 'ayat'),
a AS (SELECT *, lead(n) OVER (PARTITION BY load_id ORDER BY n) AS nx FROM n) SELECT load_id, unnest(range(n + 1, nx))::INT AS missing FROM a WHERE nx - n > 1""",
    "x_page_chunks": """WITH s AS (SELECT raw_id, total_pages AS n, unnest(range(1, (greatest(1, ceil((total_pages - 10) / 6.0)::INT * 6 + 1) + 1)::BIGINT, 6))::INT AS first_page FROM tree_docs WHERE total_pages >= 1)
SELECT raw_id, row_number() OVER (PARTITION BY raw_id ORDER BY first_page)::INT AS chunk_no, first_page, least(first_page + 9, n) AS last_page FROM s""",
    "x_reference_mode": """WITH q AS (SELECT DISTINCT query_id, query, reference_mode, regexp_matches(query, '(?i)\\b(pasal|ayat|huruf)\\s+\\(?[0-9a-z]+') AS l, regexp_matches(query, '(?i)\\b(uu|pp|perpres|perda|pergub|permen[a-z]*|peraturan[a-z]*)\\s+(nomor|no)\\b') AS d FROM gt_items WHERE query IS NOT NULL)
SELECT CASE WHEN l AND d THEN 'both' WHEN l THEN 'legal_ref' WHEN d THEN 'doc_only' ELSE 'none' END AS inferred, reference_mode, count(DISTINCT query_id) AS n FROM q GROUP BY ALL""",
    "x_slugs": "SELECT scrape_id, regexp_replace(regexp_replace(lower(trim(judul)), '[^a-z0-9.]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM registry WHERE judul IS NOT NULL",
    "x_content_words": f"SELECT DISTINCT query_id, array_to_string({_content('query')}, ' ') AS words FROM gt_items WHERE query IS NOT NULL",
    "x_paraphrase_overlap": f"""WITH {CUR}, n AS (SELECT {DOC.format(c="doc_id")} AS doc_id, {NODE.format(c="node_id")} AS node_id, arg_max(text, load_id) AS text FROM cur WHERE text IS NOT NULL GROUP BY ALL),
q AS (SELECT DISTINCT query_id, query, {GD} AS doc_id, {GA} AS node_id FROM gt_items WHERE query_type = 'paraphrased'),
j AS (SELECT query_id, text, {_content("coalesce(query, '')")} AS a, {_content("text")} AS b FROM q LEFT JOIN n USING (doc_id, node_id)),
s AS (SELECT query_id, CASE WHEN text IS NOT NULL THEN CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END END AS raw FROM j)
SELECT query_id, round(raw, 3) AS overlap, raw IS NULL OR raw > 0.4 AS flagged FROM s""",
    "x_cleaning_gate": """WITH o AS (SELECT load_id, text, lag(text) OVER w AS old, row_number() OVER w AS nth FROM nodes WHERE node_id IS NOT NULL WINDOW w AS (PARTITION BY granularity, doc_id, node_id ORDER BY loaded_at, load_id))
SELECT load_id, coalesce(length(text)::DOUBLE / nullif(length(old), 0) BETWEEN 0.85 AND 1.15 AND len(regexp_extract_all(text, '\\([0-9]+\\)')) >= len(regexp_extract_all(old, '\\([0-9]+\\)')), false) AS accepted FROM o WHERE nth > 1""",
    "a_combo_summary": f"""WITH {U} SELECT system, eval_granularity, count(*) AS n, count(*) FILTER (WHERE error <> '') AS n_errors, round(avg(coalesce(elapsed_s, 0)), 8) AS mean_elapsed_s,
  round(avg(coalesce(total_tokens, 0)), 8) AS mean_tokens, round(avg(coalesce(llm_calls, 0)), 8) AS mean_calls FROM u GROUP BY ALL""",
    "a_slices": f"WITH {U}, g AS (SELECT query_id, min(reference_mode) AS reference_mode, min(query_style) AS query_style FROM gt_items GROUP BY 1), j AS (SELECT u.*, reference_mode, query_style FROM u LEFT JOIN g USING (query_id)) "
    + " UNION ALL ".join(f"SELECT '{f}' AS slice, coalesce({f}, '') AS value, count(*) AS n, round(avg(CASE WHEN worker_ok THEN 1.0::DOUBLE WHEN NOT worker_ok THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 4) AS success_rate FROM j GROUP BY ALL" for f in sm.SLICES),
    "a_retry_plan": f"""WITH {U}, c AS (SELECT run_id, {_error_case()} AS error_class, coalesce(retry_count, 0) AS tries FROM u WHERE error <> ''), w AS (SELECT *, CASE WHEN error_class = 'rate-limit' THEN CASE WHEN tries = 0 THEN 30 ELSE 90 END WHEN error_class IN ('network', 'worker-crash') THEN CASE WHEN tries = 0 THEN 15 ELSE 45 END END AS wait_s FROM c)
SELECT run_id, error_class, wait_s IS NOT NULL AS retryable, wait_s FROM w""",
    "a_totals": f"WITH {U} SELECT system, eval_granularity, grouping_id(system, eval_granularity)::INT AS level, count(*) AS n, sum(coalesce(total_tokens, 0))::BIGINT AS tokens, sum(coalesce(llm_calls, 0))::BIGINT AS calls FROM u WHERE coalesce(worker_ok, true) GROUP BY ROLLUP (system, eval_granularity)",
    "a_percentiles": f"WITH {U} SELECT system, round(quantile_cont(elapsed_s, 0.5), 8) AS p50, round(quantile_cont(elapsed_s, 0.95), 8) AS p95, round(quantile_cont(elapsed_s, 0.99), 8) AS p99 FROM u WHERE elapsed_s >= 0 GROUP BY 1",
    "a_nearest_percentiles": f"""WITH {U}, r AS (SELECT system, total_tokens, row_number() OVER (PARTITION BY system ORDER BY total_tokens) - 1 AS i, count(*) OVER (PARTITION BY system) AS n FROM u WHERE total_tokens >= 0)
SELECT system, max(total_tokens) FILTER (WHERE i = least(floor(n * 0.5), n - 1)) AS median_upper, max(total_tokens) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95 FROM r GROUP BY 1""",
    "a_error_classes": f"WITH {U} SELECT {_error_case()} AS error_class, system, count(*) AS n FROM u WHERE error <> '' GROUP BY ALL",
    "a_token_cost": f"""WITH {U}, p(llm_model, i, o) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in sm.PRICES)}),
g AS (SELECT llm_model, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens FROM u WHERE llm_model IS NOT NULL GROUP BY 1)
SELECT g.llm_model, input_tokens, output_tokens, round(coalesce((input_tokens * i + output_tokens * o) / 1e6, 0), 4)::DOUBLE AS cost FROM g LEFT JOIN p USING (llm_model)""",
    "a_cost_by_style": f"WITH {U}, s AS (SELECT query_id, min(query_style) AS query_style FROM gt_items GROUP BY 1) SELECT coalesce(query_style, 'unknown') AS query_style, count(*) AS n, round(avg(total_tokens), 8) AS mean_tokens, round(avg(elapsed_s), 8) AS mean_elapsed_s FROM u LEFT JOIN s USING (query_id) GROUP BY 1",
    "a_repeats": f"WITH {U}, l AS (SELECT system, worker_ok, lag(worker_ok) OVER (PARTITION BY system, query_id ORDER BY started_at, run_id) AS before FROM u) SELECT system, count(*) AS n_repeats, sum(CASE WHEN before = worker_ok THEN 1 WHEN before <> worker_ok THEN 0 END)::BIGINT AS n_same_outcome FROM l WHERE before IS NOT NULL GROUP BY 1",
    "a_gt_statistics": "SELECT query_type, query_style, reference_mode, count(DISTINCT query_id) AS n_queries, count(DISTINCT gold_anchor_node_id) AS n_anchors FROM gt_items GROUP BY ALL",
    "a_type_by_mode": "WITH k AS (SELECT DISTINCT query_id, query_type, reference_mode AS m FROM gt_items) SELECT query_type, count(*) FILTER (WHERE m = 'none') AS \"none\", count(*) FILTER (WHERE m = 'legal_ref') AS legal_ref, count(*) FILTER (WHERE m = 'doc_only') AS doc_only, count(*) FILTER (WHERE m = 'both') AS \"both\" FROM k GROUP BY 1",
    "a_fingerprints": "SELECT split_name, count(DISTINCT query_id) AS n, sha256(string_agg(DISTINCT query_id::VARCHAR, chr(10) ORDER BY query_id)) AS fingerprint FROM (SELECT DISTINCT split_name, query_id FROM gt_splits WHERE split_name IS NOT NULL) GROUP BY 1".replace("DISTINCT query_id::VARCHAR, chr(10)", "query_id::VARCHAR, chr(10)"),
    "a_corpus_status": f"""WITH {REG}, j AS (SELECT reg.*, doc_id IN (SELECT doc_id FROM nodes WHERE doc_id IS NOT NULL) AS i, doc_id IN (SELECT doc_id FROM tree_docs WHERE doc_id IS NOT NULL) AS f FROM reg)
SELECT jenis_folder, count(*) AS n_docs, count(*) FILTER (WHERE has_pdf) AS n_pdf, count(*) FILTER (WHERE removed_at IS NULL) AS n_there, count(*) FILTER (WHERE i) AS n_indexed,
  count(*) FILTER (WHERE NOT i AND f) AS n_only_fetched, count(*) FILTER (WHERE NOT i AND NOT f) AS n_neither FROM j GROUP BY 1""",
    "d_gt_errors": f"""WITH {CUR}, k AS (SELECT DISTINCT {DOC.format(c="doc_id")} AS d, {NODE.format(c="node_id")} AS a, granularity AS g FROM cur), i AS (SELECT *, {GD} AS d, {GA} AS a FROM gt_items)
SELECT DISTINCT query_id, unnest(list_filter([CASE WHEN length(trim(coalesce(query, ''))) < 10 THEN 'short_query' END, CASE WHEN NOT coalesce(query_type IN ('factual', 'paraphrased', 'multihop'), false) THEN 'bad_type' END,
  CASE WHEN NOT coalesce(reference_mode IN ('none', 'legal_ref', 'doc_only', 'both'), false) THEN 'bad_mode' END, CASE WHEN d IS NULL THEN 'no_document' END, CASE WHEN a IS NULL THEN 'no_anchor' END,
  CASE WHEN a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.d = i.d AND k.a = i.a AND k.g = i.gold_anchor_granularity) THEN 'anchor_unknown' END,
  CASE WHEN coalesce(len(gold_anchor_node_ids), 0) <> CASE WHEN query_type = 'multihop' THEN 2 ELSE 1 END THEN 'anchor_arity' END], lambda x: x IS NOT NULL)) AS error FROM i""",
    "d_collected": f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC) AS rn FROM gt_items WHERE query_id IS NOT NULL) WHERE rn = 1),
o AS (SELECT min(query_id) AS query_id FROM b GROUP BY lower(trim(coalesce(query, '')))),
w AS (SELECT min(query_id) AS query_id FROM b SEMI JOIN o USING (query_id) GROUP BY coalesce({GD}, ''), coalesce({GA}, ''), coalesce(query_type, ''))
SELECT printf('q%03d', row_number() OVER (ORDER BY query_id)) AS seq_id, query_id FROM w""",
    "d_quality_scores": f"WITH {QUAL} SELECT * FROM qv",
    "d_eligibility": f"""WITH {REG}, {QUAL} SELECT coalesce(reg.doc_id, qv.doc_id) AS doc_id, CASE WHEN verdict IN ('OK', 'PARTIAL') AND removed_at IS NULL THEN 'keep' WHEN verdict IS NOT NULL THEN 'drop'
  WHEN NOT coalesce(has_pdf, false) THEN 'orphan' ELSE 'pending' END AS decision FROM reg FULL JOIN qv ON reg.doc_id = qv.doc_id""",
    "d_stale": "WITH r AS (SELECT doc_id, max(scraped_at) AS s FROM registry WHERE doc_id IS NOT NULL GROUP BY 1), n AS (SELECT doc_id, max(loaded_at) AS l FROM nodes GROUP BY 1) SELECT r.doc_id, CASE WHEN l IS NULL THEN 'missing' WHEN l >= s THEN 'fresh' ELSE 'stale' END AS state FROM r LEFT JOIN n ON n.doc_id = r.doc_id",
    "d_resume": "SELECT DISTINCT query_id FROM gt_items WHERE query_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM query_runs q WHERE q.query_id = gt_items.query_id AND system = 'llm_agent' AND logged_at IS NOT NULL)",
    "d_mirror": "SELECT DISTINCT doc_id, 'push' AS action FROM registry WHERE doc_id NOT IN (SELECT doc_id FROM nodes WHERE doc_id IS NOT NULL) UNION ALL SELECT DISTINCT doc_id, 'delete' FROM nodes WHERE doc_id NOT IN (SELECT doc_id FROM registry WHERE doc_id IS NOT NULL)",
    "d_registry_upsert": f"WITH {REG} SELECT doc_id, scrape_id, status FROM reg",
    "s_paired": f"WITH {PAIRS} SELECT query_id, eval_granularity, round(va, 6) AS va, round(vb, 6) AS vb FROM pr",
    "s_paired_test": f"""WITH {PAIRS}, g AS (SELECT eval_granularity, count(*) AS n, avg(va - vb) AS m, coalesce(stddev_samp(va - vb), 0) AS s FROM pr GROUP BY 1), e AS (SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE m / s END AS d FROM g)
SELECT eval_granularity, n, round(m, 4) AS mean_diff, round(d * sqrt(n), 4) AS t, round(d, 4) AS cohens_d, CASE WHEN s = 0 THEN 'zero-variance' ELSE {_label("d")} END AS label FROM e""",
    "s_bootstrap_hash": f"""WITH {U}, v AS (SELECT run_id, system, elapsed_s AS v FROM u WHERE elapsed_s >= 0), e AS (SELECT system, v, r, ('0x' || substr(md5(md5(run_id::VARCHAR) || '|' || r::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS uu FROM v, (SELECT unnest(range(1, 101)) AS r)),
w AS (SELECT system, r, v, {_poisson()} AS w FROM e), m AS (SELECT system, r, sum(w * v) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
i AS (SELECT system, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m GROUP BY 1)
SELECT v.system, count(*) AS n, round(avg(v), 4) AS mean, any_value(low) AS low, any_value(high) AS high FROM v JOIN i USING (system) GROUP BY 1""",
    "s_randomization_hash": f"""WITH {PAIRS}, d AS (SELECT query_id, eval_granularity, round(va - vb, 6) AS d FROM pr), e AS (SELECT eval_granularity, r, round(sum(CASE WHEN substr(md5(query_id::VARCHAR || '|' || r::VARCHAR), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN -d ELSE d END), 4) AS s FROM d, (SELECT unnest(range(1, 201)) AS r) GROUP BY ALL),
b AS (SELECT eval_granularity, count(*) AS n, round(sum(d), 4) AS s0 FROM d GROUP BY 1)
SELECT eval_granularity, n, round((sum(CASE WHEN abs(s) >= abs(s0) THEN 1 ELSE 0 END) + 1) / 201.0::DOUBLE, 4) AS p FROM e JOIN b USING (eval_granularity) GROUP BY ALL""",
    "s_hamilton": f"""WITH g AS (SELECT query_type, count(DISTINCT query_id) AS t FROM gt_items GROUP BY 1), x AS (SELECT query_type, t, i, part, round(t * share, 9) AS x, floor(round(t * share, 9))::BIGINT AS base FROM g, {SHARES}),
y AS (SELECT *, t - sum(base) OVER (PARTITION BY query_type) AS missing, row_number() OVER (PARTITION BY query_type ORDER BY x - base DESC, i) AS place FROM x) SELECT query_type, part, base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS n FROM y""",
    "s_stratified_pick": f"""WITH {CUR}, d AS (SELECT doc_id, count(*) AS leaf_count, string_split(doc_id, '-')[1] AS folder FROM cur WHERE is_leaf GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY leaf_count, doc_id) - 1 AS i, count(*) OVER (PARTITION BY folder) AS t FROM d),
s AS (SELECT *, least(CASE WHEN t <= 5 THEN i ELSE (i * 5 + 4) // t END, 4)::INT AS stratum FROM r)
SELECT folder, stratum, arg_min(doc_id, (md5('42|' || doc_id), doc_id)) AS doc_id FROM s GROUP BY ALL""",
    "s_adaptive_n": f"WITH {CUR} SELECT doc_id, count(*) AS n, CASE WHEN count(*) < 5 THEN 0 ELSE least(count(*), 5) END::BIGINT AS quota FROM cur WHERE is_leaf GROUP BY 1",
    "x_deep_split": LN_DEEP,
    "x_headings": f"SELECT load_id, md5({_headings('text')}) AS text_md5 FROM nodes WHERE text IS NOT NULL",
    "d_document_checks": f"""WITH {CUR}, r AS (SELECT granularity, doc_id, ord_path, node_id, nullif(regexp_extract(node_id, '^pasal_([0-9]+)', 1), '')::INT AS n, is_leaf, text FROM cur),
m AS (SELECT *, n < lag(n) OVER (PARTITION BY granularity, doc_id ORDER BY ord_path, node_id) AS falls FROM r),
g AS (SELECT granularity, doc_id, count(DISTINCT n) AS n_articles, greatest(coalesce(max(n) - min(n) + 1 - count(DISTINCT n), 0), 0)::BIGINT AS n_missing, count(*) FILTER (WHERE is_leaf AND coalesce(trim(text), '') = '') AS n_empty, count(*) FILTER (WHERE falls) AS falls FROM m GROUP BY ALL)
SELECT granularity, doc_id, n_articles, n_missing, n_empty, falls = 0 AS monotonic, CASE WHEN n_articles = 0 THEN 'FAIL' WHEN n_missing > 0 OR n_empty > 0 OR falls > 0 THEN 'WARN' ELSE 'OK' END AS verdict FROM g""",
    "t_page_ends": f"""WITH {CUR}, l AS (SELECT *, lead(start_index) OVER (PARTITION BY granularity, doc_id, coalesce(parent_id, '') ORDER BY ord_path, node_id) AS nx FROM cur)
SELECT {K}, start_index, CASE WHEN nx IS NULL THEN end_index ELSE greatest(start_index, nx - 1) END AS derived_end FROM l""",
    "d_review_states": f"""WITH a AS (SELECT query_id, {GD} AS d FROM gt_items), b AS (SELECT DISTINCT {DOC.format(c="doc_id")} AS d FROM nodes), al AS (SELECT d FROM b UNION SELECT d FROM a)
SELECT d AS doc_id, CASE WHEN d NOT IN (SELECT d FROM b WHERE d IS NOT NULL) THEN 'not-built' WHEN d IN (SELECT d FROM a WHERE d IS NOT NULL AND query_id IN (SELECT query_id FROM gt_splits)) THEN 'applied'
  WHEN d IN (SELECT d FROM a WHERE d IS NOT NULL) THEN 'annotated' ELSE 'built' END AS state FROM al WHERE d IS NOT NULL""",
    "a_repeated_actions": f"""WITH {U}, m AS (SELECT run_id, eval_granularity AS g, lag(eval_granularity) OVER w AS b1, lag(eval_granularity, 2) OVER w AS b2 FROM u WHERE query_id IS NOT NULL WINDOW w AS (PARTITION BY system, query_id ORDER BY started_at, run_id))
SELECT run_id, CASE WHEN b1 = g AND b2 = g THEN 'stop' ELSE 'vary' END AS hint FROM m WHERE coalesce(b1 = g, false) OR coalesce(b2 = g, false)""",
    "s_quotas": f"""WITH {CUR}, p AS (SELECT string_split(doc_id, '-')[1] AS folder, doc_id, count(*) AS s FROM cur WHERE is_leaf GROUP BY ALL),
b AS (SELECT *, count(*) OVER (PARTITION BY folder) AS n, sum(s) OVER (PARTITION BY folder) AS t, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS i FROM p),
x AS (SELECT *, greatest(100 - n, 0) AS l, round(greatest(100 - n, 0) * s / t::DOUBLE, 9) AS x FROM b), f AS (SELECT *, floor(x)::BIGINT AS f FROM x),
q AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY x - f DESC, doc_id DESC) AS place, sum(f) OVER (PARTITION BY folder) AS gone FROM f)
SELECT folder, doc_id, (CASE WHEN i <= 100 THEN 1 ELSE 0 END + f + CASE WHEN place <= l - gone THEN 1 ELSE 0 END)::BIGINT AS quota FROM q""",
    "s_pricing": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL",
    "s_nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "s_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
}
