import math

import pytest
from pyspark.sql import functions as F

from legistra.functions.ids import canonical_doc, canonical_node
from legistra.operators import metrics as mt
from legistra.operators import retrieval as rt
from legistra.operators import statistics as st
from legistra.operators.corpus_tables import canonical_title, parent_prefix
from legistra.operators.scale import running_counts, salted_join
from legistra.operators.text import gap_ranges, markers, numbering_gaps, page_chunks, split_at_markers
from legistra.plans import search


def one(spark, ranked, gold, k):
    r = spark.createDataFrame([("q", x, i) for i, x in enumerate(ranked, 1)], "query_id string, item string, rank int")
    g = spark.createDataFrame([("q", x) for x in gold], "query_id string, item string")
    return mt.per_query(mt.ranked_unique(r, "item"), g, "item", (k,)).first()


def test_metrics_of_known_lists(spark):
    m = one(spark, "ab", "a", 1)
    assert (m.hit, m.recall, m.mrr, m.first_rank) == (1, 1, 1, 1)
    m = one(spark, "abc", "ac", 10)
    assert m.ndcg < 1 and m.map == round((1 + 2 / 3) / 2, 6) and m.mrr == 1 and m.recall == 1
    m = one(spark, "xyz", "a", 10)
    assert (m.hit, m.recall, m.mrr, m.map, m.ndcg, m.first_rank) == (0, 0, 0, 0, 0, None)
    m = one(spark, "xya", "a", 3)
    assert m.mrr == round(1 / 3, 6) and m.hit == 1
    m = one(spark, [f"x{i}" for i in range(11)] + ["a"], "a", 10)
    assert m.mrr == 0 and m.first_rank == 12


def test_ids(spark):
    docs = [" UU_12_2019.json", "uu 12 2019", "Uu-12-2019 ", "", "  ", None]
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i").select(canonical_doc(F.col("d"))).collect()]
    assert got == ["uu-12-2019"] * 3 + [None] * 3
    nodes = ["uu-1-2019/Pasal-3-Ayat-2", " pasal_3_ayat_2 ", "PASAL_3_AYAT_2", " ", None]
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(nodes)], "i int, d string").orderBy("i").select(canonical_node(F.col("d"))).collect()]
    assert got == ["pasal_3_ayat_2"] * 3 + [None] * 2


def test_parents_and_titles(spark):
    rows = [("pasal_3_ayat_2_huruf_a", "pasal_3_ayat_2", "Pasal 3 Ayat (2) Huruf a"), ("pasal_3_ayat_2", "pasal_3", "Pasal 3 Ayat (2)"), ("pasal_3", "", "Pasal 3")]
    df = spark.createDataFrame(rows, "id string, parent string, title string")
    assert df.where((parent_prefix(F.col("id")) != F.col("parent")) | (canonical_title(F.col("id")) != F.col("title"))).count() == 0


def test_running_counts_match_a_window(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id", F.lit(2).alias("n"))
    got = {(r.id, r.b) for r in running_counts(df, ["k"], [F.col("v"), F.col("id")], "n", "b").collect()}
    seen, want = {}, set()
    for r in sorted(df.collect(), key=lambda r: (r.k, r.v, r.id)):
        want.add((r.id, seen.get(r.k, 0)))
        seen[r.k] = seen.get(r.k, 0) + 2
    assert got == want


def test_salted_join_keeps_everything(spark):
    a = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    b = spark.createDataFrame([(0, "x")], "k bigint, v string")
    assert salted_join(a, b, ["k"], ["id"]).count() == 500
    assert salted_join(a, b, ["k"], ["id"], "left").count() == 1000
    assert salted_join(a, b, ["k"], ["id"], "left_anti").count() == 500


def brute_bm25(queries, docs):
    import re
    from collections import Counter

    tok = lambda s: [t for t in re.findall("[a-z0-9]+", s.lower()) if len(t) > 1 or t.isdigit()]
    ds = {k: tok(v) for k, v in docs.items()}
    n, avg = len(ds), sum(map(len, ds.values())) / len(ds)
    df = Counter(t for d in ds.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in queries.items():
        for k, d in ds.items():
            tf = Counter(d)
            s = sum((raw[t] if raw[t] >= 0 else floor) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in tok(text) if t in tf)
            if any(t in tf for t in tok(text)):
                out[q, k] = round(s, 4)
    return out


def test_bm25_against_brute_force(spark):
    docs = {1: "the fee of the boat", 2: "boat boat boat levy", 3: "a permit for the fee 7", 4: "", 5: "levy the levy", 6: "nothing here"}
    queries = {10: "boat fee fee", 11: "7 levy", 12: "", 13: "unseen"}
    d = spark.createDataFrame(list(docs.items()), "k int, t string")
    q = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    got = {(r.query_id, r.k): r.score for r in rt.bm25_scores(q, d, ["k"], "t").collect()}
    want = brute_bm25(queries, docs)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-4 for x in want)


@pytest.mark.parametrize("name", ["r_hybrid_tree", "r_hybrid_tree_rrf"])
def test_tree_search_keeps_small_plans(spark, sf, name):
    # picks and leaves are kept once they are found, so that a plan doesn't repeat them for every reader
    plan = getattr(search, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 20


@pytest.mark.parametrize("name", ["r_bm25_flat_top10", "r_bm25_candidates20"])
def test_flat_search_makes_no_row_of_a_pair(spark, sf, name):
    plan = getattr(search, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("key", ["int", "string"])
def test_best_by_blocks_are_those_of_all_scores(spark, monkeypatch, key):
    monkeypatch.setattr(rt, "_blocks", lambda batches, blocks=rt._blocks: blocks(batches, 5, 70))
    texts = [" ".join(f"w{int((i * 37 + j * j * 11) % 101) % (2 + j * 3)}" for j in range(i % 23)) for i in range(400)]
    d = spark.createDataFrame([*enumerate(texts), (400, "w1 lone")], "k int, t string").withColumn("k", F.col("k").cast(key)).repartition(2)
    q = spark.createDataFrame([(i, f"w{i} w{i} w1 w{i % 7 + 20} w0") for i in range(30)] + [(90, ""), (91, "unseen"), (92, "lone")], "query_id int, query string")
    got = {(r.query_id, r["rank"]): (r.k, r.score) for r in rt.bm25_top(q, d, "k", "t", 7, block=11).collect()}
    want = {(r.query_id, r["rank"]): (r.k, r.score) for r in rt.top_k(rt.bm25_scores(q, d, ["k"], "t"), 7, ["k"]).collect()}
    assert len(got) > 150 and got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-4 for x in want)


def test_rank_lists(spark):
    L = lambda s: spark.createDataFrame([(1, x, i) for i, x in enumerate(s, 1)], "query_id int, i string, rank int")
    order = lambda d: "".join(r.i for r in d.orderBy("rank").collect())
    assert order(rt.interleave(L("abc"), L("bde"), "i", 4)) == "abdc"
    assert order(rt.reciprocal_rank_fusion(L("abc"), L("cba"), "i"))[0] in "ac"
    assert order(rt.borda(L("abc"), L("cab"), "i")) == "acb"
    model = spark.createDataFrame([(1, "c", 1), (1, "zz", 2), (1, "c", 3), (1, "a", 4)], "query_id int, i string, pos int")
    assert order(rt.validated(model, L("abc"), "i")) == "cab"
    h = rt.hallucinations(model, L("abc"), "i").first()
    assert (h.n_ranked, h.n_unknown) == (4, 1)


def test_beam_reaches_the_right_leaf(spark):
    nodes = spark.createDataFrame(
        [("d", "a", "", "1", False, "boats"), ("d", "b", "", "2", False, "fees"), ("d", "a1", "a", "1.1", True, "boat sizes"), ("d", "b1", "b", "2.1", True, "late fees"), ("d", "b2", "b", "2.2", True, "other")],
        "doc_id string, node_id string, parent_id string, ord_path string, is_leaf boolean, label string",
    )
    q = spark.createDataFrame([(1, "late fees", "d")], "query_id int, query string, doc_id string")
    assert [r.node_id for r in rt.beam_search(q, nodes, width=1).collect()] == ["b1"]


def beam_tables(spark, path, nodes):
    cols = "doc_id string, node_id string, parent_id string, ord_path string, title string, summary string, text string"
    rest = ["'rincian' as granularity", "null as penjelasan", "'' as navigation_path", "timestamp'2024-01-01' as loaded_at", "cast(null as timestamp) as deleted_at", "cast(1 as bigint) as load_id"]
    spark.createDataFrame(nodes, cols).selectExpr("*", *rest).selectExpr("*", "text <> '' as is_leaf").write.parquet(f"{path}/nodes.parquet")
    asked = "cast(50 as bigint) as query_id", "'late boat fee' as query", "'d' as gold_doc_id", "cast(null as array<string>) as gold_doc_ids"
    spark.range(1).selectExpr(*asked).write.parquet(f"{path}/gt_items.parquet")
    return {r.node_id: r for r in search.r_beam_tree(spark, str(path)).collect()}


def test_beam_takes_whole_levels_of_leaves(spark, tmp_path):
    leaves = [("d", f"n{i}", "", str(i), "leaf", "", "late fee" if i == 11 else f"other matter {i}") for i in range(1, 12)]
    got = beam_tables(spark, tmp_path, leaves)
    # the eleventh leaf is ranked first by its text, zeros follow in reading order
    assert sorted(got, key=lambda n: got[n].rank) == ["n11", *[f"n{i}" for i in range(1, 10)]]
    assert {r.found_in for r in got.values()} == {1} and got["n11"].score > 0 == got["n1"].score


def test_beam_goes_down_by_summaries(spark, tmp_path):
    tops = [("d", x, "", str(i), "part", s, "") for i, (x, s) in enumerate(zip("abcde", ["", "late", "fee", "", "boat fee"], strict=True), 1)]
    below = [("d", f"{x}{i}", x, f"{k}.{i}", "leaf", "", f"fee number {x}{i}") for k, x in enumerate("abcde", 1) for i in range(1, 5)]
    mixed = [("d", "f", "", "6", "boat late fee", "", "a leaf beside parts")]
    got = beam_tables(spark, tmp_path, tops + below + mixed)
    # f is the best of the top, then e and one of b and c, all whose leaves are taken
    assert got["f"].found_in == 1 and {f"e{i}" for i in range(1, 5)} <= set(got) and len(got) == 9


def test_beam_keeps_texts_once_a_document(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(rt, "cut", lambda df, cut=rt.cut: kept.append(cut(df)) or kept[-1])
    nodes = spark.createDataFrame(
        [("d", f"n{i}", "", str(i), "leaf", f"late fee {i}", i) for i in range(1, 5)] + [("e", "a", "", "1", "part", "", 9), ("e", "b", "a", "1.1", "leaf", "boat fee", 10)],
        "doc_id string, node_id string, parent_id string, ord_path string, label string, search_text string, load_id bigint",
    )
    picks = spark.createDataFrame([(q, "boat fee", d) for q in range(20) for d in "de"], "query_id bigint, query string, doc_id string")
    got = {(r.query_id, r["rank"]): r.load_id for r in rt.bm25_tree(picks, nodes).collect()}
    assert {got[q, 1] for q in range(20)} == {10} and {got.get((q, 2)) for q in range(20)} == {1}
    assert sum(d.count() for d in kept if "search_text" in d.columns) == 6


def test_tournament_runs_to_its_end(spark, tmp_path):
    rows = [(1, i, float(i % 97)) for i in range(200)] + [(2, i, 1.0) for i in range(3)]
    spark.createDataFrame(rows, "query_id bigint, cand_id bigint, llm_score double").write.parquet(f"{tmp_path}/retrieved.parquet")
    got = search.r_tournament(spark, str(tmp_path)).collect()
    last = max(r["round"] for r in got)
    assert len(got) == 203 and 1 <= sum(r["round"] == last for r in got if r.query_id == 1) <= 4
    # 200, 100, 50, 26, 14, 8, 4
    assert last == 6 and {r["round"] for r in got if r.query_id == 2} == {0}


def test_statistics(spark):
    df = spark.createDataFrame([("g", 713)], "k string, t bigint")
    assert {r.part: r.n for r in st.largest_remainder(df, "k", "t", [("dev", 0.4), ("val", 0.3), ("test", 0.3)]).collect()} == {"dev": 285, "val": 214, "test": 214}
    cells = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 10)], "k string, n bigint")
    got = {r.k: (r.n_train, r.n_val, r.n_test) for r in st.cell_allocation(cells, ["k"], "n").collect()}
    assert got == {"a": (1, 0, 0), "b": (1, 1, 0), "c": (1, 0, 1), "d": (4, 3, 3)}
    flat = spark.createDataFrame([("g", 1.0, 0.0)] * 3, "eval_granularity string, va double, vb double")
    assert st.paired_test(flat).first().label == "zero-variance"
    labels = spark.createDataFrame([(0.0,), (0.3,), (1.5,), (-2.5,)], "d double").select(st.effect_label(F.col("d"))).collect()
    assert [r[0] for r in labels] == ["trivial", "small", "very large", "huge"]
    parts = st.greedy_parts(spark.createDataFrame([("g", i, 4) for i in range(5)] + [("h", 0, 99)], "g string, o int, n int"), "g", "o", "n", 9)
    assert sorted((r.g, r.o, r.part) for r in parts.collect()) == [("g", 0, 1), ("g", 1, 1), ("g", 2, 2), ("g", 3, 2), ("g", 4, 3), ("h", 0, 1)]


def test_chunks_and_clauses(spark):
    got = page_chunks(spark.createDataFrame([(1, 10), (2, 17), (3, None)], "k int, n int"), "k", "n").orderBy("k", "chunk_no").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 10), (2, 1, 1, 10), (2, 2, 7, 16), (2, 3, 13, 17)]
    got = split_at_markers(spark.createDataFrame([(1, "intro\n(1) one\nmore\n(2) two")], "k int, t string"), "k", "t").orderBy("part").collect()
    assert [(r.part, r.label, r.n_lines) for r in got] == [(0, "", 1), (1, "1", 2), (2, "2", 1)]


def test_gaps_beside_a_marker_that_is_far_off(spark):
    rows = [(1, "(1) a\n(2) b\n(5) c\n(12019) d"), (2, "(1) a\n(2) b"), (3, "(2) a\n(2) b\n(4) c")]
    found = markers(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert sorted(map(tuple, gap_ranges(found, "k").collect())) == [(1, 3, 4), (1, 6, 12018), (3, 3, 3)]
    assert sorted(map(tuple, numbering_gaps(found, "k").collect())) == [(1, 3), (1, 4), *[(1, n) for n in range(6, 12019)], (3, 3)]
