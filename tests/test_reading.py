import time

import pytest
from pyspark.sql import functions as F

from legistra.operators import evaluation as ev
from legistra.operators import parsing as ps
from legistra.operators import scale
from legistra.operators import splitting as sp
from legistra.operators import summaries as sm
from legistra.operators import views as vw
from legistra.plans import reading

LEAVES = "load_id bigint, node_id string, title string, text string"


def test_deep_split_goes_from_clauses_to_items(spark):
    text = "Awal\n(1) Satu:\na. alfa\nb. beta:\n1. x\n2. y\n(2) Dua sebagaimana dimaksud pada ayat\n(1) tetap\n(3) Tiga"
    rows = spark.createDataFrame([(1, "pasal_1", "Pasal 1", text), (2, "pasal_2", "Pasal 2", "(1) allein"), (3, "pasal_3", None, "")], LEAVES)
    got = {(r.load_id, r.node_id): (r.title, r.parent_id) for r in sp.deep_nodes(rows).collect()}
    assert got[1, "pasal_1"] == ("Pasal 1", "") and got[2, "pasal_2"] == ("Pasal 2", "")
    assert got[1, "pasal_1_ayat_1_huruf_b_angka_2"] == ("Pasal 1 Ayat (1) Huruf b Angka 2", "pasal_1_ayat_1_huruf_b")
    assert {k[1] for k in got if k[0] == 1} == {
        "pasal_1", "pasal_1_ayat_1", "pasal_1_ayat_1_huruf_a", "pasal_1_ayat_1_huruf_b", "pasal_1_ayat_1_huruf_b_angka_1", "pasal_1_ayat_1_huruf_b_angka_2", "pasal_1_ayat_2", "pasal_1_ayat_3",
    }
    assert sp.deep_nodes(rows.limit(0)).count() == 0


def test_marks_must_make_a_run(spark):
    rows = spark.createDataFrame([(1, "(1) a\n(2) b\n(2) b"), (2, "(2) a\n(3) b"), (3, "(1) a\n(3) b"), (4, None), (5, "(1) a\n(12019) b")], "k int, t string")
    got = {(r.k, r.line_no, r.label) for r in sp.valid_marks(rows, ["k"], "t", "ayat").collect()}
    assert got == {(1, 1, "1"), (1, 3, "2")}


def test_summaries_from_the_leaves_up(spark):
    rows = [
        ("d", "a", "", "1", 1, "A", None, None), ("d", "b", "a", "1.1", 2, "B", "Satu dua. Tiga.", None), ("d", "c", "a", "1.2", 2, "C", "Empat", "sudah"),
        ("d", "e", "", "2", 1, None, None, "  "), (None, "z", None, None, 1, None, "x", None),
    ]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ord_path string, depth int, title string, text string, summary string")
    got = {r.node_id: r.summary for r in sp.bottom_up(nodes).collect()}
    assert got == {"b": "Satu dua", "c": "sudah", "a": "B: Satu dua C: sudah", "e": "", "z": "x"}
    assert sp.bottom_up(nodes.limit(0)).count() == 0


def test_ids_from_titles(spark):
    titles = {
        "Pasal 3 ayat (2) huruf a angka 1": "pasal_3_ayat_2_huruf_a_angka_1", "Pasal 12A": "pasal_12A", "BAB IV Umum": "bab_iv", "Bagian Kedua": "up_bagian_kedua",
        "Paragraf 2": "up_paragraf_2", "Lain-lain!": "lain_lain", "": "node", None: "node",
    }
    rows = spark.createDataFrame([(i, "!", t, "up") for i, t in enumerate(titles)] + [(99, "pasal_7", "Pasal 8", None)], "k int, node_id string, title string, ancestor string")
    got = {r.k: r.node_id for r in ps.node_ids(rows, ["k"]).collect()}
    assert [got[i] for i in range(len(titles))] == list(titles.values()) and got[99] == "pasal_7"


def test_paths_of_titles(spark):
    tree = spark.createDataFrame([(1, "1", " A "), (1, "1.1", "B"), (1, "1.1.2", None), (1, "2", "C")], "k int, ord_path string, title string")
    assert {r.ord_path: r.path for r in ps.navigation_paths(tree, "k").collect()} == {"1": "A", "1.1": "A > B", "1.1.2": "A > B > ", "2": "C"}


def test_cleaned_pages(spark):
    seen = "PRESIDEN\nREPUBLIK INDONESIA\nisi  satu\n- 2 -\nlanjutPasal 3\nPasal4\n(2t dua (s)\nPasal 7...\n\n\n\nakhir . . ."
    got = spark.createDataFrame([(seen,), (None,), ("",)], "t string").select(ps.cleaned_page(F.col("t"))).collect()
    assert got[0][0].split("\n")[0] == "isi satu" and "lanjut\nPasal 3" in got[0][0] and "Pasal 4" in got[0][0] and "(2) dua (5)" in got[0][0] and got[0][0].endswith("akhir")
    assert got[1][0] is None and got[2][0] == ""


@pytest.mark.parametrize(("much", "firsts"), [(4_000_000, 256), (0, 256), (0, 3), (0, 1)])
def test_pages_of_titles(spark, monkeypatch, much, firsts):
    monkeypatch.setattr(ps, "FIRSTS", firsts)
    titles = ["Pasal 1", "Pasal  12", "Pasal 3", "aab", "x" * 50, "Judul yang dibaca sampai empat puluh huruf saja", "\u00e9\U0001f600 b", "ab", None, " "]
    current = spark.createDataFrame([("pasal", d, f"n{i}", 9, t) for d in "de" for i, t in enumerate(titles)], "granularity string, doc_id string, node_id string, start_index int, title string")
    texts = [(1, "Pasal\n 12 aaab"), (2, "Pasal 3"), (3, "y" + "x" * 45), (4, "ini Judul yang dibaca  sampai empat puluh huruf lagi"), (5, "\u00e9\n\U0001f600 \u00e9\U0001f600\tb"), (6, "Pasal 3 Pasal 1 aab"), (7, None)]
    pages = spark.createDataFrame([("d", *x) for x in texts], "doc_id string, page_num int, raw_text string")
    got = {(r.doc_id, r.node_id): r.found_page for r in ps.title_pages(current, pages, much).collect()}
    assert got == {("d", f"n{i}"): p for i, p in enumerate([1, 1, 2, 1, 3, 4, 5, 1])} | {("e", f"n{i}"): 9 for i in range(8)}


def test_titles_of_a_long_regulation(spark):
    # 9,000 titles in 4 pages of 300,000 characters and more: seconds, not a search of every page for every title
    n, per = 9000, 2250
    current = spark.range(1, n + 1).selectExpr("'pasal' as granularity", "'d' as doc_id", "concat('pasal_', id) as node_id", "cast(0 as int) as start_index", "concat('Pasal ', id) as title")
    texts = [(p + 1, "\n".join(f"Pasal {i}\n" + "isi  ketentuan " * 10 for i in range(p * per + 1, (p + 1) * per + 1))) for p in range(4)]
    pages = spark.createDataFrame([("d", *x) for x in texts], "doc_id string, page_num int, raw_text string")
    began = time.time()
    got = {r.node_id: r.found_page for r in ps.title_pages(current, pages).collect()}
    assert time.time() - began < 20
    assert got == {f"pasal_{i}": min(p for p, t in texts if f"Pasal {i}" in t) for i in range(1, n + 1)}


def test_article_chunks_reach_the_last_page(spark):
    pages = spark.createDataFrame([("d", p, f"Pasal {p}\nisi") for p in range(1, 9)] + [("e", 1, "Pasal 1"), ("f", 1, None)], "doc_id string, page_num int, raw_text string")
    got = [(r.chunk_no, r.first_page, r.last_page) for r in ps.article_chunks(pages, 3).orderBy("chunk_no").collect()]
    assert got == [(1, 1, 4), (2, 3, 7), (3, 6, 8)]


@pytest.mark.parametrize(("path", "stays"), [("Menimbang", {"x"}), ("BAB I", {"x", "y"})])
def test_preambles(spark, path, stays):
    rows = spark.createDataFrame([("pasal", "d", "x", "BAB II"), ("pasal", "d", "y", path), ("pasal", "e", "z", "Mengingat")], "granularity string, doc_id string, node_id string, navigation_path string")
    assert {r.node_id for r in vw.without_preamble(rows).collect()} == stays | {"z"}


def test_records_without_hits(spark):
    ranked = spark.createDataFrame([(1, "d/a", 1), (1, "d/b", 2), (2, "e/a", 1)], "query_id int, item string, rank int")
    gold = spark.createDataFrame([(1, "d/b"), (2, "x/y"), (3, "x/z")], "query_id int, item string")
    got = {r.query_id: r for r in ev.query_records(ranked, gold).collect()}
    assert (got[1].full_rr, got[1].top1, got[1].doc_pick_count, got[1].within_doc_mrr) == (0.5, 0, 2, 0.5)
    assert got[2].doc_pick_hit == 0 and got[3].hit == 0 and got[3].full_rr == 0


def test_error_classes(spark):
    seen = ["Errno 2 x", "no relevant nodes", "HTTP 429", "read timed out", "503", "JSON decode", "bad json", "worker exited 1", "odd", "", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in seen], "e string").select(sm.error_class(F.col("e"))).collect()]
    assert got == ["missing-index", "llm-empty", "rate-limit", "network", "network", "worker-crash", "other", "worker-crash", "other", None, None]


def test_hot_keys_are_salted_and_others_are_not(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 50)
    left = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.range(400).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")).unionByName(spark.createDataFrame([("hot", 2)], "k string, v int"))
    assert len(scale.hot_keys(left, ["k"], 50)) == 1 and scale.hot_keys(left.limit(0), ["k"], 50) == {}
    got = scale.salted_join(left, right, ["k"], by=["id"])
    assert got.count() == 400 and got.where("v = 2").count() == 134
    assert scale.salted_join(left, right.where("v = 2"), ["k"], by=["id"], how="left_anti").count() == 266


def test_interpolated_percentiles(spark):
    rows = [(i, "s" if i % 2 else None, float(i), "", i) for i in range(1, 41)]
    runs = spark.createDataFrame(rows, "run_id int, system string, elapsed_s double, error string, logged_at int").withColumn("started_at", F.lit(0))
    got = {r.system: r.p50 for r in sm.interpolated_percentiles(runs).collect()}
    assert got == {"s": 20.0, None: 21.0}


def test_every_query_runs_on_the_smallest_tables(spark, sf):
    for name, query in reading.QUERIES.items():
        assert query(spark, sf).count() >= 0, name


def test_kept_tables_are_dropped_on_demand(spark):
    import glob

    from legistra.session import drop_tables, persist_table, shared_dir

    kept = persist_table(spark.range(3).toDF("id"), "three")
    assert kept.count() == 3
    mine = shared_dir(spark).removeprefix("file://") + f"/tables/{spark.sparkContext.applicationId}"
    assert glob.glob(mine + "/three-*")
    drop_tables(spark)
    assert not glob.glob(mine)
