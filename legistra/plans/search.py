"""Queries on search, ranked lists and their metrics.

Searches take as queries every ground-truth record, or vector, whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from legistra.functions.ids import canonical_doc, canonical_node, gold_doc
from legistra.operators import corpus_tables as ct
from legistra.operators import metrics as mt
from legistra.operators import retrieval as rt
from legistra.operators.agents import finalized
from legistra.plans.corpus import DOC, NODE
from legistra.session import cut
from legistra.sources.tables import table

# ---------------------------------------------------------------- inputs


def _leaves(spark, sf, granularity):
    return ct.leaves(ct.current_nodes(table(spark, sf, "nodes")), granularity)


def _asked(spark, sf):
    g = table(spark, sf, "gt_items").where("query_id % 50 = 0 and query is not null")
    doc = gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids"))
    return g.groupBy("query_id").agg(F.min("query").alias("query"), F.min(doc).alias("doc_id"))


def _candidates(spark, sf, score, ascending=False):
    """The candidates of `retrieved` as a ranked list by one score."""
    from pyspark.sql import Window

    r = table(spark, sf, "retrieved").where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    item = F.concat_ws("/", canonical_doc(F.col("doc_id")), canonical_node(F.col("node_id")))
    order = F.col(score).asc() if ascending else F.col(score).desc()
    best = r.select("query_id", item.alias("item"), "cand_id", score)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "cand_id")))


def _by_bm25(spark, sf):
    return mt.ranked_unique(_candidates(spark, sf, "bm25_score"), "item")


def _by_dense(spark, sf):
    return mt.ranked_unique(_candidates(spark, sf, "dense_score"), "item")


def _gold(spark, sf):
    g = table(spark, sf, "gt_items")
    anchors = F.concat(F.array("gold_anchor_node_id"), F.coalesce("gold_anchor_node_ids", F.array().cast("array<string>")))
    doc = gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids"))
    rows = g.select("query_id", doc.alias("doc"), F.explode(anchors).alias("a"))
    rows = rows.select("query_id", "doc", canonical_node(F.col("a")).alias("node")).where("doc is not null and node is not null")
    return rows.select("query_id", F.concat_ws("/", "doc", "node").alias("item")).distinct()


# ---------------------------------------------------------------- queries


def r_token_stats(spark, sf):
    words = _leaves(spark, sf, None).select("granularity", F.explode(rt.terms(F.col("search_text"))).alias("term"))
    return words.groupBy("granularity").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


def r_term_idf(spark, sf):
    leaf = _leaves(spark, sf, "pasal")
    post = rt.postings(leaf, ["load_id"], "search_text")
    idf = rt.inverse_frequencies(post, leaf.agg(F.count("*").alias("n_docs")))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def r_bm25_flat_top10(spark, sf):
    return rt.bm25_top(_asked(spark, sf), _leaves(spark, sf, "pasal"), "load_id", "search_text", 10)


def r_bm25_candidates20(spark, sf):
    return rt.bm25_top(_asked(spark, sf), _leaves(spark, sf, "rincian"), "load_id", "search_text", 20)


def _summaries(current):
    """doc_id, summaries: what a document's articles are about, in reading order, one a line."""
    cur = current.where("granularity = 'pasal' and summary is not null and trim(summary) <> ''")
    sums = cur.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord_path", "node_id", "summary"))).alias("s"))
    return sums.select("doc_id", F.array_join(F.transform("s", lambda x: F.trim(x["summary"])), "\n").alias("summaries"))


def _catalog(spark, sf):
    reg = ct.newest(table(spark, sf, "registry").where("doc_id is not null"), ["doc_id"], ["scraped_at", "scrape_id"])
    sums = _summaries(ct.current_nodes(table(spark, sf, "nodes")))
    parts = [F.coalesce(c, F.lit("")) for c in ("judul", "jenis_folder", "bentuk_singkat")]
    text = F.concat_ws(" ", *parts)
    text = F.when(F.coalesce("summaries", F.lit("")) != "", F.concat_ws(" ", text, "summaries")).otherwise(text)
    return reg.join(sums, "doc_id", "left").select("doc_id", text.alias("doc_text"))


def r_catalog(spark, sf):
    return _catalog(spark, sf).select("doc_id", F.length("doc_text").cast("bigint").alias("n_chars"), F.md5("doc_text").alias("text_md5"))


def r_doc_pick3(spark, sf):
    return rt.bm25_top(_asked(spark, sf), _catalog(spark, sf), "doc_id", "doc_text", 3)


def r_within_doc_top10(spark, sf):
    leaf = _leaves(spark, sf, "pasal").withColumn("doc_id", canonical_doc(F.col("doc_id")))
    scored = rt.within_document(_asked(spark, sf).where("doc_id is not null"), leaf)
    return rt.top_k(scored, 10, ["load_id"], positive=False).select("query_id", "doc_id", "load_id", "score", "rank")


def r_beam_tree(spark, sf):
    cur = ct.current_nodes(table(spark, sf, "nodes")).where("granularity = 'rincian'")
    label = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    text = ct.enriched(F.col("title"), F.col("navigation_path"), F.col("text"), F.col("penjelasan"))
    tree = cur.select(canonical_doc(F.col("doc_id")).alias("doc_id"), "node_id", "parent_id", "ord_path", label.alias("label"), text.alias("search_text"))
    return rt.bm25_beam(_asked(spark, sf).where("doc_id is not null"), tree)


def r_rrf(spark, sf):
    return rt.reciprocal_rank_fusion(_by_bm25(spark, sf), _by_dense(spark, sf), "item")


def r_borda(spark, sf):
    return rt.borda(_by_bm25(spark, sf), _by_dense(spark, sf), "item")


def r_interleave10(spark, sf):
    return rt.interleave(_by_bm25(spark, sf), _by_dense(spark, sf), "item", 10)


def _reranked(spark, sf):
    """The twenty BM25 candidates of each query, and the stand-in model's order of them."""
    top = r_bm25_candidates20(spark, sf).select("query_id", "load_id", "rank")
    texts = _leaves(spark, sf, "rincian").select("load_id", "search_text")
    both = top.join(texts, "load_id").join(_asked(spark, sf).select("query_id", "query"), "query_id")
    return top, rt.overlap_ranking(both, "load_id", "query", "search_text")


def r_hybrid_flat(spark, sf):
    top, model = _reranked(spark, sf)
    return rt.validated(model, top, "load_id")


def r_hybrid_rrf(spark, sf):
    top, model = _reranked(spark, sf)
    return rt.reciprocal_rank_fusion(top, model.select("query_id", "load_id", F.col("pos").alias("rank")), "load_id").where("rank <= 10")


def r_bm25_tree(spark, sf):
    """Three documents picked per query, a beam in each, and what it reaches ranked as a corpus of its own.

    The articles of the given tables have no children, so the beam takes them all, as the SQL does.
    """
    label = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    picked = _picked(spark, sf)
    tree = cut(_picked_leaves(spark, sf, picked).select("doc_id", "node_id", "parent_id", "ord_path", label.alias("label"), "search_text", "load_id"))
    return rt.bm25_tree(picked.drop("pick"), tree)


def _picked(spark, sf):
    """query_id, query, doc_id, pick: the three documents picked for a query."""
    picks = r_doc_pick3(spark, sf).select("query_id", "doc_id", F.col("rank").alias("pick"))
    return cut(picks.join(_asked(spark, sf).select("query_id", "query"), "query_id"))


def _picked_leaves(spark, sf, picked):
    """The articles of the documents that any query picked."""
    nodes = table(spark, sf, "nodes").where("granularity = 'pasal'").join(picked.select("doc_id").distinct(), "doc_id", "left_semi")
    return ct.leaves(ct.current_nodes(nodes))


def _tree_candidates(picked, leaf):
    """query_id, load_id, score, rank: the ten best leaves of each picked document, one document after the other."""
    from pyspark.sql import Window

    within = rt.within_document(picked.drop("pick"), leaf)
    best = within.withColumn("at", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "load_id"))).where("at <= 10")
    placed = best.join(picked.select("query_id", "doc_id", "pick"), ["query_id", "doc_id"])
    return placed.select("query_id", "load_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("pick", "at")).alias("rank"))


def _tree_reranked(spark, sf):
    # each step is kept, as the steps after it read it more than once
    picked = _picked(spark, sf)
    leaf = cut(_picked_leaves(spark, sf, picked).select("doc_id", "load_id", "search_text"))
    top = cut(_tree_candidates(picked, leaf))
    asked = picked.groupBy("query_id").agg(F.min("query").alias("query"))
    both = top.join(leaf.select("load_id", "search_text"), "load_id").join(asked, "query_id")
    return top, rt.overlap_ranking(both, "load_id", "query", "search_text")


def r_hybrid_tree(spark, sf):
    """The candidates of the picked documents in the order of the stand-in model, ten a query."""
    top, model = _tree_reranked(spark, sf)
    return rt.validated(model, top.select("query_id", "load_id", "rank"), "load_id").where("rank <= 10")


def r_hybrid_tree_rrf(spark, sf):
    """The same candidates by their scores in their own documents, fused with the model's order."""
    from pyspark.sql import Window

    top, model = _tree_reranked(spark, sf)
    across = top.select("query_id", "load_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")).alias("rank"))
    return rt.reciprocal_rank_fusion(across, model.select("query_id", "load_id", F.col("pos").alias("rank")), "load_id").where("rank <= 10")


def r_dense_reranked(spark, sf):
    """The fifty nearest vectors of a query, put in the order of a stand-in model: those of its own label first, then by cosine."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = rt.cosine_top_k(q, e.select("vec_id", F.col("embedding").alias("v")), 50)
    labels = e.select("vec_id", "label")
    told = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    score = (F.col("label") == F.col("own")).cast("double")
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    ranked = told.withColumn("rerank_score", score).withColumn("final", F.row_number().over(w))
    return ranked.where("final <= 10").select("query_id", "vec_id", F.col("cosine").alias("cosine_score"), "rerank_score", F.col("final").alias("rank"))


def _model_ranking(spark, sf):
    """The order a reranking model gave, with its nulls gone, as an external ranking."""
    c = _candidates(spark, sf, "rerank_position", ascending=True)
    return c.select("query_id", "item", F.col("rank").alias("pos"))


def r_validated(spark, sf):
    return rt.validated(_model_ranking(spark, sf), _by_bm25(spark, sf), "item")


def r_final_ten(spark, sf):
    """What an agent that reads the reranked candidates in order would hand in: ten documents, each once."""
    c = _candidates(spark, sf, "rerank_position", ascending=True).select("query_id", "rank", F.substring_index("item", "/", 1).alias("doc"))
    lists = c.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc"))).alias("l"))
    final = finalized(F.transform("l", lambda x: x["doc"]), 10)
    return lists.select("query_id", F.size(final).alias("n"), F.array_join(final, " ").alias("docs"))


def r_hallucinations(spark, sf):
    return rt.hallucinations(_model_ranking(spark, sf), _by_bm25(spark, sf), "item")


def r_tournament(spark, sf):
    r = table(spark, sf, "retrieved").where("llm_score is not null")
    return rt.tournament(r, "cand_id", "llm_score", window=4, survivors=2)


def r_cosine_top10(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rt.cosine_top_k(q, e.select("vec_id", F.col("embedding").alias("v")), 10)


def r_vector_label_recall(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    top = r_cosine_top10(spark, sf).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return top.groupBy("own").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("precision_at_10"))


def m_per_query(spark, sf):
    return mt.per_query(_by_bm25(spark, sf), _gold(spark, sf), "item")


def m_by_type(spark, sf):
    kinds = table(spark, sf, "gt_items").groupBy("query_id").agg(F.min("query_type").alias("query_type"))
    each = m_per_query(spark, sf).join(kinds, "query_id")
    names = ("hit", "recall", "precision", "f1", "ndcg", "map", "mrr")
    return each.groupBy("query_type", "k").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in names])


def m_sibling(spark, sf):
    strip = lambda d: d.withColumn("item", F.substring_index("item", "/", -1))
    return mt.sibling_hits(mt.ranked_unique(strip(_by_bm25(spark, sf)), "item"), strip(_gold(spark, sf)), "item")


def m_sibling_failures(spark, sf):
    hit = m_per_query(spark, sf).where("k = 10").select("query_id", "hit")
    missed = m_sibling(spark, sf).join(hit, "query_id").where("hit = 0")
    return missed.agg(F.count("*").alias("n_failures"), F.coalesce(F.sum("sibling_hit"), F.lit(0)).alias("n_near_misses"))


def m_rank_distribution(spark, sf):
    return mt.rank_distribution(m_per_query(spark, sf).where("k = 10"))


def m_docpick(spark, sf):
    """Whether the gold document is among the documents of the ten best candidates, and how many of those it holds."""
    top = _by_bm25(spark, sf).where("rank <= 10").select("query_id", F.substring_index("item", "/", 1).alias("doc"))
    gold = _gold(spark, sf).select("query_id", F.substring_index("item", "/", 1).alias("doc")).distinct()
    n = top.join(gold, ["query_id", "doc"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_from_gold"))
    return gold.select("query_id").distinct().join(n, "query_id", "left").select(
        "query_id", F.coalesce("n_from_gold", F.lit(0)).alias("n_from_gold"), F.when(F.col("n_from_gold") > 0, 1).otherwise(0).alias("doc_hit")
    )


QUERIES = {
    f.__name__: f
    for f in (
        r_token_stats, r_term_idf, r_bm25_flat_top10, r_bm25_candidates20, r_catalog, r_doc_pick3, r_within_doc_top10, r_beam_tree, r_rrf, r_borda,
        r_interleave10, r_hybrid_flat, r_hybrid_rrf, r_bm25_tree, r_hybrid_tree, r_hybrid_tree_rrf, r_dense_reranked, r_final_ten, r_validated, r_hallucinations, r_tournament, r_cosine_top10, r_vector_label_recall, m_per_query, m_by_type, m_sibling,
        m_sibling_failures, m_rank_distribution, m_docpick,
    )
}

# ---------------------------------------------------------------- SQL

CUR = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY granularity, doc_id, node_id ORDER BY loaded_at DESC, load_id DESC) AS rn
  FROM nodes WHERE granularity IS NOT NULL AND doc_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL)"""
LEAF = """leaf AS (SELECT *, coalesce(title, '') || ' ' || coalesce(navigation_path, '') || ' ' || text ||
  CASE WHEN penjelasan <> '' AND penjelasan <> 'Cukup jelas.' THEN ' ' || penjelasan ELSE '' END AS search_text
  FROM cur WHERE is_leaf AND text IS NOT NULL AND text <> '')"""
ASKED = f"""asked AS (SELECT query_id, min(query) AS query, min(coalesce({DOC.format(c="gold_doc_id")}, {DOC.format(c="gold_doc_ids[1]")})) AS doc_id
  FROM gt_items WHERE query_id % 50 = 0 AND query IS NOT NULL GROUP BY query_id)"""


def _tok(c):
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"


def _bm25(corpus, key, text, within=""):
    """CTEs that end in `scored` (query_id, key, score)."""
    w = f"{within}, " if within else ""
    on = f" AND p.{within} = q.{within}" if within else ""
    group = f"GROUP BY {within}" if within else ""
    join = f"USING ({within})" if within else "ON true"
    return f"""words AS (SELECT {w}{key} AS k, unnest({_tok(text)}) AS term FROM {corpus}),
sized AS (SELECT {w}{key} AS k, len({_tok(text)}) AS dl FROM {corpus}),
post AS (SELECT {"words." + within + ", " if within else ""}words.k, term, count(*) AS f, any_value(dl) AS dl FROM words JOIN sized ON words.k = sized.k{" AND words." + within + " = sized." + within if within else ""} GROUP BY ALL),
st AS (SELECT {w}count(*) AS n, avg(dl)::DOUBLE AS avgdl FROM sized {group}),
d AS (SELECT {w}term, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT {w}term, df, n, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM d JOIN st {join}),
mean AS (SELECT {w}avg(r) AS m FROM raw {group}),
idf AS (SELECT {w}term, df, avgdl, CASE WHEN r < 0 THEN 0.25::DOUBLE * m ELSE r END AS idf FROM raw JOIN mean {join}),
q AS (SELECT query_id, {w}term, count(*) AS qf FROM (SELECT query_id, {w}unnest({_tok("query")}) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT q.query_id, {"q." + within + ", " if within else ""}p.k AS {key if key != within else "kk"}, round(sum(qf * idf.idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / avgdl))), 4) AS score
  FROM q JOIN idf ON q.term = idf.term{" AND q." + within + " = idf." + within if within else ""} JOIN post p ON p.term = q.term{on} GROUP BY ALL)"""


def _top(key, k, where="WHERE score > 0", extra=""):
    return f"""SELECT query_id, {extra}{key}, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM scored {where}) WHERE rank <= {k}"""


ITEM = f"{DOC.format(c='doc_id')} || '/' || {NODE.format(c='node_id')}"


def _list(name, score, direction="DESC"):
    return f"""{name}0 AS (SELECT query_id, {ITEM} AS item, row_number() OVER (PARTITION BY query_id ORDER BY {score} {direction}, cand_id) AS plc FROM retrieved
  WHERE {score} IS NOT NULL AND NOT isnan({score}::DOUBLE)),
{name} AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY plc) AS rank FROM (SELECT query_id, item, min(plc) AS plc FROM {name}0 WHERE item <> '' GROUP BY ALL))"""


A, B_ = _list("a", "bm25_score"), _list("b", "dense_score")
MODEL = f"""m AS (SELECT query_id, {ITEM} AS item, row_number() OVER (PARTITION BY query_id ORDER BY rerank_position, cand_id) AS pos FROM retrieved WHERE rerank_position IS NOT NULL)"""
GOLD = f"""gold AS (SELECT DISTINCT query_id, doc || '/' || node AS item FROM (
  SELECT query_id, coalesce({DOC.format(c="gold_doc_id")}, {DOC.format(c="gold_doc_ids[1]")}) AS doc, {NODE.format(c="x")} AS node
  FROM (SELECT *, unnest(list_concat([gold_anchor_node_id], coalesce(gold_anchor_node_ids, []))) AS x FROM gt_items)) WHERE doc IS NOT NULL AND node IS NOT NULL)"""
PER_QUERY = f"""{A}, {GOLD},
nrel AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY 1),
h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM a SEMI JOIN gold USING (query_id, item)),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
e AS (SELECT nrel.query_id, k, n_rel, count(h.rank) FILTER (WHERE h.rank <= k) AS n, min(h.rank) AS fr,
  coalesce(sum(1.0::DOUBLE / log2(h.rank + 1.0::DOUBLE)) FILTER (WHERE h.rank <= k), 0.0::DOUBLE) AS dcg,
  coalesce(sum(i::DOUBLE / h.rank) FILTER (WHERE h.rank <= k), 0.0::DOUBLE) AS sp
  FROM nrel CROSS JOIN ks LEFT JOIN h ON h.query_id = nrel.query_id GROUP BY ALL),
mq AS (SELECT query_id, k, CASE WHEN n > 0 THEN 1 ELSE 0 END AS hit, round(n / n_rel::DOUBLE, 6) AS recall, round(n / k::DOUBLE, 6) AS precision,
  round(CASE WHEN n > 0 THEN 2 * (n / k::DOUBLE) * (n / n_rel::DOUBLE) / (n / k::DOUBLE + n / n_rel::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS f1,
  round(dcg / list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda r: 1.0::DOUBLE / log2(r + 1.0::DOUBLE))), 6) AS ndcg,
  round(sp / n_rel, 6) AS map, round(CASE WHEN fr <= k THEN 1.0::DOUBLE / fr ELSE 0.0::DOUBLE END, 6) AS mrr, fr::INT AS first_rank FROM e)"""
PARENT = "CASE WHEN len(string_split({c}, '_')) < 4 THEN '' ELSE array_to_string(string_split({c}, '_')[1:len(string_split({c}, '_')) - 2], '_') END"
SIB = f"""{_list("z", "bm25_score")},
zs AS (SELECT query_id, string_split(item, '/')[-1] AS item, rank FROM z),
z1 AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY plc) AS rank FROM (SELECT query_id, item, min(rank) AS plc FROM zs WHERE item <> '' GROUP BY ALL)),
sg AS (SELECT DISTINCT query_id, string_split(item, '/')[-1] AS item FROM gold),
sp AS (SELECT DISTINCT query_id, {PARENT.format(c="item")} AS parent FROM sg),
so AS (SELECT DISTINCT z1.query_id FROM z1 ANTI JOIN sg USING (query_id, item) JOIN sp ON sp.query_id = z1.query_id AND sp.parent = {PARENT.format(c="z1.item")} WHERE rank <= 10 AND parent <> ''),
sib AS (SELECT DISTINCT sg.query_id, CASE WHEN so.query_id IS NULL THEN 0 ELSE 1 END AS sibling_hit FROM sg LEFT JOIN so ON so.query_id = sg.query_id)"""
CATALOG = f"""reg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY scraped_at DESC, scrape_id DESC) AS rn FROM registry WHERE doc_id IS NOT NULL) WHERE rn = 1),
sums AS (SELECT doc_id, string_agg(trim(summary), chr(10) ORDER BY ord_path, node_id, summary) AS s FROM cur WHERE granularity = 'pasal' AND trim(summary) <> '' GROUP BY 1),
cat AS (SELECT reg.doc_id, coalesce(judul, '') || ' ' || coalesce(jenis_folder, '') || ' ' || coalesce(bentuk_singkat, '') || CASE WHEN coalesce(s, '') <> '' THEN ' ' || s ELSE '' END AS doc_text FROM reg LEFT JOIN sums ON sums.doc_id = reg.doc_id)"""
COSINE = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS cosine
  FROM embeddings, q WHERE query_id <> vec_id),
top AS (SELECT query_id, vec_id, cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10)"""


def _tour(r, source, window=4, survivors=2):
    return f"""n{r} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, (row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id::VARCHAR || '|' || cand_id::VARCHAR || '|{r}'), cand_id) - 1) // {window} AS chunk FROM {source}),
p{r} AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk ORDER BY llm_score DESC, cand_id) AS place FROM n{r}),
l{r} AS (SELECT query_id, cand_id, llm_score, CASE WHEN n <= {window} THEN round ELSE {r} END AS round FROM p{r} WHERE n <= {window} OR place <= {survivors}),
x{r} AS (SELECT query_id, cand_id, {r - 1} AS round FROM p{r} WHERE NOT (n <= {window} OR place <= {survivors}))"""


RERANKED = f"""{CUR}, {LEAF}, {ASKED}, pl AS (SELECT * FROM leaf WHERE granularity = 'rincian'), {_bm25('pl', 'load_id', 'search_text')}, a AS ({_top('load_id', 20)}),
b AS (SELECT a.query_id, a.load_id, row_number() OVER (PARTITION BY a.query_id ORDER BY len(list_intersect(list_distinct({_tok("query")}), list_distinct({_tok("search_text")}))) DESC, a.load_id)::INT AS pos
  FROM a JOIN pl ON pl.load_id = a.load_id JOIN asked ON asked.query_id = a.query_id)"""

TREE = f"""{CUR}, {LEAF}, pk AS (WITH {CATALOG}, {ASKED}, {_bm25('cat', 'doc_id', 'doc_text')} SELECT query_id, doc_id, rank AS pick FROM ({_top('doc_id', 3, '')}) WHERE score > 0),
pl AS (SELECT * FROM leaf WHERE granularity = 'pasal'), {ASKED.replace("asked AS", "asked0 AS", 1)}, asked AS (SELECT asked0.query_id, asked0.query, pk.doc_id, pick FROM asked0 JOIN pk ON pk.query_id = asked0.query_id),
{_bm25('pl', 'load_id', 'search_text', 'doc_id')},
wd AS (SELECT asked.query_id, asked.query, asked.doc_id, pick, pl.load_id, pl.search_text, coalesce(s.score, 0) AS score FROM asked JOIN pl ON pl.doc_id = asked.doc_id LEFT JOIN scored s ON s.query_id = asked.query_id AND s.doc_id = asked.doc_id AND s.load_id = pl.load_id),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, load_id) AS nth FROM wd), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pick, nth) AS rank FROM wr WHERE nth <= 10),
b AS (SELECT query_id, load_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(list_distinct({_tok("query")}), list_distinct({_tok("search_text")}))) DESC, load_id)::INT AS pos FROM a)"""

ORACLES = {
    "r_final_ten": f"""WITH {MODEL}, d AS (SELECT query_id, string_split(item, '/')[1] AS doc, min(pos) AS p FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS i FROM d)
SELECT query_id, count(*)::INT AS n, string_agg(doc, ' ' ORDER BY i) AS docs FROM r WHERE i <= 10 GROUP BY 1""",
    "r_hybrid_flat": f"WITH {RERANKED} SELECT query_id, load_id, pos AS rank FROM b",
    "r_hybrid_rrf": f"""WITH {RERANKED}, f AS (SELECT a.query_id, a.load_id, a.rank AS place, round(1.0::DOUBLE / (60 + a.rank) + 1.0::DOUBLE / (60 + pos), 6) AS fused FROM a JOIN b ON a.query_id = b.query_id AND a.load_id = b.load_id)
SELECT * FROM (SELECT query_id, load_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, place)::INT AS rank FROM f) WHERE rank <= 10""",
    "r_bm25_tree": f"""WITH {CUR}, {LEAF}, picks AS (WITH {CATALOG}, {ASKED}, {_bm25('cat', 'doc_id', 'doc_text')} SELECT query_id, doc_id FROM ({_top('doc_id', 3, '')}) WHERE score > 0),
pool AS (SELECT picks.query_id AS qid, leaf.* FROM picks JOIN leaf ON leaf.doc_id = picks.doc_id WHERE granularity = 'pasal'), {ASKED.replace("asked AS", "asked0 AS", 1)}, asked AS (SELECT *, query_id AS qid FROM asked0),
{_bm25('pool', 'load_id', 'search_text', 'qid')} {_top('load_id', 10)}""",
    "r_hybrid_tree": f"WITH {TREE} SELECT query_id, load_id, pos AS rank FROM b WHERE pos <= 10",
    "r_hybrid_tree_rrf": f"""WITH {TREE}, x AS (SELECT query_id, load_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM a),
f AS (SELECT x.query_id, x.load_id, x.rank AS place, round(1.0::DOUBLE / (60 + x.rank) + 1.0::DOUBLE / (60 + pos), 6) AS fused FROM x JOIN b ON x.query_id = b.query_id AND x.load_id = b.load_id)
SELECT * FROM (SELECT query_id, load_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, place)::INT AS rank FROM f) WHERE rank <= 10""",
    "r_dense_reranked": f"""WITH {COSINE.replace("rank <= 10", "rank <= 50")}, s2 AS (SELECT query_id, top.vec_id, cosine AS cosine_score, CASE WHEN e.label = o.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rerank_score, rank AS r FROM top JOIN embeddings e ON e.vec_id = top.vec_id JOIN embeddings o ON o.vec_id = top.query_id)
SELECT * FROM (SELECT query_id, vec_id, cosine_score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, r)::INT AS rank FROM s2) WHERE rank <= 10""",
    "r_token_stats": f"WITH {CUR}, {LEAF} SELECT granularity, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM (SELECT granularity, unnest({_tok('search_text')}) AS term FROM leaf) GROUP BY 1",
    "r_term_idf": f"WITH {CUR}, {LEAF}, {ASKED}, pl AS (SELECT * FROM leaf WHERE granularity = 'pasal'), {_bm25('pl', 'load_id', 'search_text')} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "r_bm25_flat_top10": f"WITH {CUR}, {LEAF}, {ASKED}, pl AS (SELECT * FROM leaf WHERE granularity = 'pasal'), {_bm25('pl', 'load_id', 'search_text')} {_top('load_id', 10)}",
    "r_bm25_candidates20": f"WITH {CUR}, {LEAF}, {ASKED}, pl AS (SELECT * FROM leaf WHERE granularity = 'rincian'), {_bm25('pl', 'load_id', 'search_text')} {_top('load_id', 20)}",
    "r_catalog": f"WITH {CUR}, {CATALOG} SELECT doc_id, length(doc_text) AS n_chars, md5(doc_text) AS text_md5 FROM cat",
    "r_doc_pick3": f"WITH {CUR}, {CATALOG}, {ASKED}, {_bm25('cat', 'doc_id', 'doc_text')} SELECT * FROM ({_top('doc_id', 3, '')}) WHERE score > 0",
    "r_within_doc_top10": f"""WITH {CUR}, {LEAF}, {ASKED}, pl AS (SELECT * REPLACE ({DOC.format(c='doc_id')} AS doc_id) FROM leaf WHERE granularity = 'pasal'), {_bm25('pl', 'load_id', 'search_text', 'doc_id')},
w AS (SELECT asked.query_id, asked.doc_id, pl.load_id, coalesce(s.score, 0) AS score FROM asked JOIN pl ON pl.doc_id = asked.doc_id LEFT JOIN scored s ON s.query_id = asked.query_id AND s.doc_id = asked.doc_id AND s.load_id = pl.load_id)
SELECT * FROM (SELECT query_id, doc_id, load_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, load_id)::INT AS rank FROM w) WHERE rank <= 10""",
    "r_rrf": f"""WITH {A}, {B_}, e AS (SELECT query_id, item, rank, rank AS place FROM a UNION ALL SELECT query_id, item, rank, NULL FROM b),
z AS (SELECT query_id, max(rank) AS n FROM a GROUP BY 1),
f AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused, max(place) AS place FROM e GROUP BY ALL)
SELECT f.query_id, item, fused, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, coalesce(place, n + 1), item)::INT AS rank FROM f LEFT JOIN z ON z.query_id = f.query_id""",
    "r_borda": f"""WITH {A}, {B_}, e AS (SELECT query_id, item, count(*) OVER (PARTITION BY query_id) - rank + 1 AS p, rank AS place FROM a UNION ALL SELECT query_id, item, count(*) OVER (PARTITION BY query_id) - rank + 1, NULL FROM b),
f AS (SELECT query_id, item, sum(p)::BIGINT AS points, max(place) AS place FROM e GROUP BY ALL)
SELECT query_id, item, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, coalesce(place, 1073741824), item)::INT AS rank FROM f""",
    "r_interleave10": f"""WITH {A}, {B_}, f AS (SELECT query_id, item, min(t) AS t FROM (SELECT query_id, item, 2 * rank AS t FROM a UNION ALL SELECT query_id, item, 2 * rank + 1 FROM b) GROUP BY ALL)
SELECT * FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY t)::INT AS rank FROM f) WHERE rank <= 10""",
    "r_validated": f"""WITH {A}, {MODEL}, p AS (SELECT query_id, item, min(pos) AS pos FROM m GROUP BY ALL)
SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY pos NULLS LAST, rank)::INT AS rank FROM a LEFT JOIN p USING (query_id, item)""",
    "r_hallucinations": f"""WITH {A}, {MODEL} SELECT m.query_id, count(*) AS n_ranked, sum(CASE WHEN a.item IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unknown FROM m LEFT JOIN a ON a.query_id = m.query_id AND a.item = m.item GROUP BY 1""",
    "r_tournament": f"""WITH t0 AS (SELECT query_id, cand_id, llm_score, 0 AS round FROM retrieved WHERE llm_score IS NOT NULL), {_tour(1, "t0")}, {_tour(2, "l1")}, {_tour(3, "l2")}
SELECT query_id, cand_id, round::INT AS round FROM x1 UNION ALL SELECT query_id, cand_id, round::INT FROM x2 UNION ALL SELECT query_id, cand_id, round::INT FROM x3 UNION ALL SELECT query_id, cand_id, round::INT FROM l3""",
    "r_cosine_top10": f"WITH {COSINE} SELECT * FROM top",
    "r_vector_label_recall": f"WITH {COSINE} SELECT o.label AS own, count(*) AS n, round(avg(CASE WHEN e.label = o.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS precision_at_10 FROM top JOIN embeddings e ON e.vec_id = top.vec_id JOIN embeddings o ON o.vec_id = top.query_id GROUP BY 1",
    "m_per_query": f"WITH {PER_QUERY} SELECT * FROM mq",
    "m_by_type": f"""WITH {PER_QUERY}, t AS (SELECT query_id, min(query_type) AS query_type FROM gt_items GROUP BY 1)
SELECT query_type, k, count(*) AS n, {", ".join(f"round(avg({m}::DOUBLE), 4) AS {m}" for m in ("hit", "recall", "precision", "f1", "ndcg", "map", "mrr"))} FROM mq JOIN t USING (query_id) GROUP BY ALL""",
    "m_sibling": f"WITH {GOLD}, {SIB} SELECT * FROM sib",
    "m_sibling_failures": f"WITH {PER_QUERY}, {SIB} SELECT count(*) AS n_failures, coalesce(sum(sibling_hit), 0)::BIGINT AS n_near_misses FROM sib JOIN mq USING (query_id) WHERE k = 10 AND hit = 0",
    "m_rank_distribution": f"WITH {PER_QUERY} SELECT count(*) AS n, count(first_rank) AS n_found, round(avg(first_rank), 6) AS mean_rank, round(quantile_cont(first_rank, 0.5), 6)::DOUBLE AS median_rank, max(first_rank) AS max_rank FROM mq WHERE k = 10",
    "m_docpick": f"""WITH {A}, {GOLD}, t AS (SELECT query_id, string_split(item, '/')[1] AS doc FROM a WHERE rank <= 10), g AS (SELECT DISTINCT query_id, string_split(item, '/')[1] AS doc FROM gold),
n AS (SELECT query_id, count(*) AS n FROM t SEMI JOIN g USING (query_id, doc) GROUP BY 1)
SELECT DISTINCT g.query_id, coalesce(n, 0) AS n_from_gold, CASE WHEN n > 0 THEN 1 ELSE 0 END AS doc_hit FROM g LEFT JOIN n ON n.query_id = g.query_id""",
}
