from datetime import datetime as D

from legistra.operators.orphans import corpus_orphans, find_orphans, orphan_report, spans

REF = "parent string, key string, at timestamp_ntz, src_id bigint"
TAR = "parent string, key string, starts_at timestamp_ntz, ends_at timestamp_ntz, note string"


def test_reasons(spark):
    day = lambda d: D(2024, 1, d)
    targets = [
        ("p", "alive", day(1), None, ""), ("p", "gone", day(1), day(5), ""), ("p", "late", day(20), None, ""),
        ("p", "twice", day(1), day(3), ""), ("p", "twice", day(8), day(12), ""), ("p", None, day(1), None, ""), ("q", "gone", day(1), None, ""),
    ]
    refs = [
        ("p", "alive", day(10), 1), ("p", "gone", day(10), 2), ("p", "gone", day(5), 3), ("p", "gone", day(4), 4), ("p", "late", day(10), 5),
        ("p", "none", day(10), 6), ("p", None, day(10), 7), ("p", "twice", day(5), 8), ("p", "twice", day(9), 9), ("p", "none", day(10), 6),
        ("p", "none", None, 10), ("p", "late", None, 11),
    ]
    got = {(r.src_id, r.reason) for r in find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TAR)).collect()}
    assert got == {(2, "deleted"), (3, "deleted"), (5, "late"), (6, "missing"), (8, "deleted"), (10, "missing")}


def test_spans_merge(spark):
    rows = [("p", "k", D(2024, 1, 1), D(2024, 2, 10), ""), ("p", "k", D(2024, 2, 1), D(2024, 3, 1), ""), ("p", "k", D(2024, 5, 1), D(2024, 5, 1), ""), ("p", "k", D(2024, 6, 1), None, "")]
    got = sorted((r.starts_at, r.ends_at) for r in spans(spark.createDataFrame(rows, TAR)).collect())
    assert got == [(D(2024, 1, 1), D(2024, 3, 1)), (D(2024, 6, 1), D(9999, 12, 31))]


def test_empty_tables(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("gt_items", "nodes", "registry")}
    none = {n: d.limit(0) for n, d in t.items()}
    assert corpus_orphans(none["gt_items"], none["nodes"], none["registry"]).count() == 0
    lonely = corpus_orphans(t["gt_items"], none["nodes"], none["registry"])
    assert {r.reason for r in lonely.select("reason").distinct().collect()} == {"missing"}
    assert orphan_report(lonely).count() > 0
