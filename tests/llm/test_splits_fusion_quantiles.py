import math
import random
import re
from collections import Counter

import pytest

from legistra.llm import fusion, quantiles, splits
from legistra.llm import queries as q

GT = "query_id bigint, query string, gold_doc_id string, gold_doc_ids array<string>, root string, n int"


def brute_groups(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def canon(s):
        s = re.sub(r"\.(json|pdf)$", "", (s or "").strip().lower())
        return re.sub(r"[\s_-]+", "-", s) or None

    for r in rows:
        keys = [("d", canon(x)) for x in [r[2], *(r[3] or [])] if canon(x)]
        text = re.sub(r"[\W_]+", "", (r[1] or "").lower())
        for k in keys + ([("q", text)] if text else []):
            parent[find(k)] = find(("r", r[0]))
    least = {}
    for x in list(parent):
        if x[0] == "d":
            least[find(x)] = min(least.get(find(x), x[1]), x[1])
    return {(r[0], least.get(find(("r", r[0])))) for r in rows}


def test_groups_with_ties_of_all_kinds(spark):
    rows = [
        (1, "Apa?", "UU_1_2019.json", None, "x", 1), (2, "apa", "pp 2 2020", [], "x", 1), (3, "lain", " pp-2-2020", ["perda-9-1999", None], "x", 1),
        (4, "sendiri", "", ["perda-7-2001"], None, 1), (5, None, None, None, None, 1), (6, "sendiri!", None, None, None, 1), (7, "", "z-1-1", None, None, 1),
        (8, "???", "z-2-2", None, None, 1), (1, "Apa?", "UU_1_2019.json", None, "x", 1),
    ]
    got = {(r.query_id, r.group_doc) for r in splits.related_groups(spark.createDataFrame(rows, GT)).collect()}
    assert got == brute_groups(rows)
    assert (6, "perda-7-2001") in got and (5, None) in got


def test_long_chains_and_a_hot_document(spark):
    rng = random.Random(5)
    rows = [(i, f"q{i}", f"d-{i}-1", [f"d-{i + 1}-1"], None, 0) for i in range(60)]
    rows += [(1000 + i, f"h{i}", "hot-1-1", [f"e-{rng.randrange(40)}-1"] if i % 7 == 0 else None, None, 0) for i in range(200)]
    got = {(r.query_id, r.group_doc) for r in splits.related_groups(spark.createDataFrame(rows, GT)).collect()}
    assert got == brute_groups(rows)


def test_forest_is_a_spanning_forest(spark):
    edges = spark.createDataFrame([("a", "b", -2), ("b", "c", -1), ("a", "c", -3), ("x", "y", -1)], "u string, v string, weight bigint")
    forest, labels = splits.spanning_forest(edges)
    assert {(r.u, r.v) for r in forest.collect()} == {("a", "c"), ("a", "b"), ("x", "y")}
    assert len({r.root for r in labels.collect()}) == 2


def test_no_records(spark):
    none = spark.createDataFrame([], GT)
    assert splits.assign_splits(splits.related_groups(none)).count() == 0


def test_splits_keep_groups_and_proportions(spark, sf):
    out = q.p1_splits(spark, sf).collect()
    by = {}
    for r in out:
        by.setdefault(r.group_doc, set()).add(r.split_name)
    assert all(len(s) == 1 for s in by.values())
    groups = spark.createDataFrame([(i, f"d{i % 2000}", f"d{i % 2000}") for i in range(4000)], "query_id bigint, group_doc string, root string")
    share = Counter(r.split_name for r in splits.assign_splits(groups).collect())
    assert abs(share["train"] / 4000 - 0.8) < 0.02 and abs(share["val"] / 4000 - 0.1) < 0.02


def test_proportions_with_uneven_groups(spark):
    """One group holds a third of the records, and sizes fall by halves: the small groups make up for it."""
    sizes = [9000, 2500, 1300, 600, 300, 150, 80, 40, *[20] * 60, *[3] * 900, *[1] * 9000]
    rows = spark.createDataFrame([(g, n) for g, n in enumerate(sizes)], "g int, n int").selectExpr("explode(sequence(1, n)) as i", "concat('d', g) as group_doc")
    groups = rows.selectExpr("hash(group_doc, i) * 1L as query_id", "group_doc", "group_doc as root")
    got = {r.split_name: r.share for r in splits.split_report(splits.assign_splits(groups)).collect()}
    assert all(abs(got[k] - v) < 0.005 for k, v in splits.PROPORTIONS.items()), got


def test_shares_of_the_whole_table(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    assert all(abs(r.share - splits.PROPORTIONS[r.split_name]) < 0.01 for r in q.p1_report(spark, big).collect())


def test_whole_tables_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/gt_items.parquet").select("query_id", "query", "gold_doc_id", "gold_doc_ids").collect()
    assert {tuple(r) for r in q.p1_found(spark, sf).collect()} == brute_groups([tuple(r) for r in d])


RET = "query_id bigint, cand_id bigint, bm25_score double, dense_score double, llm_score int, rerank_position int, rank int, better int"


def test_fusion(spark):
    rows = [
        (1, 10, 9.0, 0.9, 90, 1, 0, 0), (1, 11, 1000.0, 0.1, 10, 9, 0, 0), (1, 12, None, float("nan"), None, None, 0, 0),
        (2, 20, 1.0, None, None, None, 0, 0), (2, 21, 1.0, None, None, None, 0, 0), (None, 30, None, None, None, 3, 0, 0), (1, 10, 9.0, 0.9, 90, 1, 0, 0),
    ]
    df = spark.createDataFrame(rows, RET)
    assert {tuple(r) for r in fusion.first_of_each(fusion.fused(df)).collect()} == {(1, 10), (2, 20), (None, 30)}
    last = fusion.fused_ranking(df).where("cand_id = 12").first()
    assert last.position == 3 and last.total == 0
    assert fusion.fused(df.limit(0)).count() == 0


def test_very_large_queries_are_ranked_over_all_tasks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c % 3 if c % 2 else None, c, rng.choice([None, 1.0, 2.0, rng.random()]), rng.random(), rng.randrange(9), rng.choice([None, 3, 4]), 0, 0) for c in range(300)]
    df = spark.createDataFrame(rows, RET)
    plain = sorted(map(tuple, fusion.fused_ranking(df).collect()), key=str)
    monkeypatch.setattr(fusion, "hot_keys", lambda d, keys: {r[0]: 1 for r in d.selectExpr(f"xxhash64({keys[0]})").distinct().limit(2).collect()})
    assert sorted(map(tuple, fusion.fused_ranking(df).collect()), key=str) == plain


def test_bucket_error_and_merging(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) * rng.choice([1, -1]) for _ in range(4000)] + [0.0] * 50
    rows = [("g", i % 3, v) for i, v in enumerate(values)] + [("g", 0, None), ("g", 0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, day int, v double")
    whole = quantiles.sketch(df, ["k"], "v")
    merged = quantiles.merge(quantiles.sketch(df, ["k", "day"], "v"), ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    ordered = sorted(values)
    for r in quantiles.percentiles(merged, ["k"], (0.0, 0.05, 0.5, 0.9, 0.999, 1.0)).collect():
        true = ordered[math.floor(r.q * (len(ordered) - 1))]
        assert abs(r.estimate - true) <= 0.0100001 * abs(true)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 9 + [100.0], [0.0, 0.0, 3.0, 1e9], list(map(float, range(101)))])
def test_exact_medians(spark, values):
    import statistics

    df = spark.createDataFrame([(None, v) for v in values], "k string, v double")
    assert quantiles.exact_medians(df, ["k"], "v").first().median == statistics.median(values)


def test_outlying_runs_once_per_run(spark, sf):
    runs = spark.read.parquet(f"{sf}/query_runs.parquet")
    once = sorted(map(tuple, quantiles.outlying_runs(runs).collect()))
    assert once == sorted(map(tuple, quantiles.outlying_runs(runs.unionByName(runs)).collect()))
    assert quantiles.outlying_runs(runs.limit(0)).count() == 0
