import pytest

from legistra.llm import cross_split as cs
from legistra.llm.lexicons import INDONESIAN

ITEMS = "query_id bigint, query string, gold_doc_id string, gold_doc_ids array<string>, gold_anchor_node_id string, source string, bucket int, cls int"
BASE = "Apakah petugas pemeriksa lapangan di Kecamatan Relnamur wajib menyusun 28 laporan kegiatan tahunan?"


def pairs(spark, texts, anchors=None):
    rows = [(i, t, "uu-1-2019", None, (anchors or {}).get(i, "pasal_1"), "s", 0, 0) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, ITEMS)
    held = spark.createDataFrame([(i, "train" if i == 0 else "test") for i in range(len(texts))], "query_id bigint, split_name string")
    return {tuple(r) for r in cs.cross_split_pairs(items, held, INDONESIAN).collect()}


def test_same_questions_are_found_and_others_not(spark):
    texts = [
        BASE, BASE.upper(), "apa petugas pemeriksa lapangan di Kec. Relnamur harus menyusun 28 laporan kegiatan tahunan".replace("Kec.", "Kecamatan"),
        "di Kecamatan Relnamur, apakah petugas pemeriksa lapangan wajib menyusun 28 laporan kegiatan tahunan? terima kasih",
        BASE.replace("menyusun", "menyusnu").replace("lapangan", "lapngan"), BASE.replace("28", "29"), BASE.replace("Relnamur", "Tokfohem"),
        BASE.replace("menyusun", "menghapus"), BASE.replace("petugas pemeriksa lapangan", "auditor internal"), None, "", "  ?!",
    ]
    assert pairs(spark, texts) == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_anchors(spark):
    assert pairs(spark, [BASE] * 4, {0: "Pasal-1", 1: "uu-1-2019/pasal_1", 2: None, 3: "pasal_2"}) == {(0, 1), (0, 2)}


def test_copies_and_long_texts(spark):
    assert len(pairs(spark, [BASE] * 40)) == 39
    long = " ".join(f"kata{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3000))
    assert pairs(spark, [long, long]) == {(0, 1)}


def test_empty_tables(spark):
    items = spark.createDataFrame([], ITEMS)
    assert cs.cross_split_pairs(items, spark.createDataFrame([], "query_id bigint, split_name string")).count() == 0


def test_whole_tables_against_brute_force(spark, sf):
    items, held = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("gt_items", "gt_splits"))
    got = {tuple(r) for r in cs.cross_split_pairs(items, held, INDONESIAN).collect()}
    qs = cs.prepared(items, held, INDONESIAN)
    rows, common = qs.select("query_id", "doc", "anchor", "side", "tokens").collect(), cs.common_words(qs)
    want = set()
    for a in rows:
        for b in rows:
            if a.side == "train" and b.side == "eval" and a.doc == b.doc and (a.anchor is None or b.anchor is None or a.anchor == b.anchor):
                if cs.same_question(a.tokens, b.tokens, common, INDONESIAN):
                    want.add(tuple(sorted((a.query_id, b.query_id))))
    assert got == want


@pytest.mark.parametrize(("a", "b", "d"), [("kata", "kata", 0), ("kata", "kaat", 1), ("kata", "kat", 1), ("kata", "kuta", 1), ("abcd", "wxyz", 3)])
def test_edit_distance(a, b, d):
    assert cs.edit_distance(a, b, 2) == d


def test_bands_find_pairs_at_the_limit():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    missed = 0
    for _ in range(400):
        shared, a, b = ([word() for _ in range(n)] for n in (8, 4, 4))
        one, two = cs.signatures([shared + a, shared + b], INDONESIAN)
        missed += not (one == two).any()
    assert missed <= 2


def test_lexicon_is_the_callers(spark):
    rows = [(0, BASE, "uu-1-2019", None, "pasal_1", "s", 0, 0), (1, BASE.replace("wajib", "harus"), "uu-1-2019", None, "pasal_1", "s", 0, 0), (2, BASE.lower(), "uu-1-2019", None, None, "s", 0, 0)]
    items = spark.createDataFrame(rows, ITEMS)
    held = spark.createDataFrame([(0, "train"), (1, "test"), (2, "val")], "query_id bigint, split_name string")
    assert {tuple(r) for r in cs.cross_split_pairs(items, held).collect()} == {(0, 2)}
    assert {tuple(r) for r in cs.cross_split_pairs(items, held, INDONESIAN).collect()} == {(0, 1), (0, 2)}


def test_only_questions_that_face_another_are_hashed(spark):
    rows = [(1, "d", "a", "train"), (2, "d", "a", "eval"), (3, "d", "b", "train"), (4, "d", None, "train"), (5, "e", "a", "train"), (6, "f", None, "eval"), (7, "f", "z", "train"), (8, "f", "z", "eval")]
    q = spark.createDataFrame(rows, "query_id bigint, doc string, anchor string, side string")
    assert {r.query_id for r in cs.facing(q).collect()} == {1, 2, 4, 6, 7, 8}
