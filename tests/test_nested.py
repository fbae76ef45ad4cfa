import json

import pytest

from legistra.operators.nested import navigation_table, node_table, relation_table

SCHEMA = "raw_id bigint, structure string, ord_path string, node_id string"


def kids(o):
    if isinstance(o, list):
        for x in o:
            yield from kids(x)
    elif isinstance(o, str):
        if o.strip():
            yield from kids(json.loads(o))
    elif isinstance(o, dict):
        if o.get("title") or o.get("node_id"):
            yield o
        else:
            for v in o.values():
                yield from kids(v)


def brute(raw_id, text):
    out = []

    def walk(held, path):
        for i, n in enumerate(kids(held), 1):
            at = f"{path}.{i}" if path else str(i)
            out.append((raw_id, at, path, n.get("node_id") or ""))
            walk(n.get("nodes"), at)

    try:
        walk(json.loads(text), "")
    except (TypeError, ValueError):
        return []
    return out


TREES = {
    1: '[{"node_id":"a","title":"A","nodes":[{"title":"B"},null,{"node_id":"c","nodes":{"node_id":"d"}}]},{"title":"E"}]',
    2: json.dumps(json.dumps([{"node_id": "x", "nodes": json.dumps([{"title": "y"}])}])),
    3: '{"structure":[{"nodes":[{"title":"in"},{"nodes":[{"title":"deep"}]}]},{"title":"after"}]}',
    4: '[{"node_id":"cut","nodes":[{"title":"lost',
    5: "",
    6: None,
    7: "[]",
    8: "null",
    9: '[{"title":"t","text":"brackets ]] }} [ in text","nodes":[{"title":"u"}]}]',
    10: '[{"node_id":"p","nodes":"[{\\"title\\": \\"broken"}]',
    11: json.dumps([{"title": "long", "text": "x" * 200_000}]),
    12: '[[[{"title":"wrapped"}]], {}, [], {"nodes": []}, {"title":"","node_id":null,"nodes":[{"title":"held"}]}]',
}


def test_nodes_against_brute_force(spark):
    rows = [(k, v, "clash", "clash") for k, v in TREES.items()] + [(1, TREES[1], None, None)]
    got = sorted(tuple(r) for r in node_table(spark.createDataFrame(rows, SCHEMA)).select("raw_id", "ord_path", "parent_path", "node_id").collect())
    want = sorted(x for k, v, *_ in rows for x in brute(k, v))
    assert got == want
    assert not [r for r in got if r[0] in (4, 10)]


def test_deep_tree(spark):
    tree = {"title": "0"}
    for i in range(1, 40):
        tree = {"title": str(i), "nodes": [tree]}
    df = spark.createDataFrame([(1, json.dumps([tree]))], "raw_id bigint, structure string")
    assert node_table(df).count() == 40


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert node_table(df).count() == relation_table(df).count() == navigation_table(df).count() == 0


def test_relations_and_paths(spark):
    t = '[{"title":"A","relasi":[{"tipe_relasi":"Merujuk","ref_display":"P 1"},null],"navigation_path":["A"],"nodes":[{"title":"B","navigation_path":"A > B","relasi":{"tipe_relasi":"X"}}]}]'
    df = spark.createDataFrame([(1, t)], "raw_id bigint, structure string")
    assert sorted(map(tuple, relation_table(df).collect())) == [(1, "1", 1, "Merujuk", "P 1"), (1, "1.1", 1, "X", None)]
    assert sorted(map(tuple, navigation_table(df).collect())) == [(1, "1", 1, "A"), (1, "1.1", 1, "A"), (1, "1.1", 2, "B")]


def test_whole_table_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/tree_docs.parquet")
    got = sorted(tuple(r) for r in node_table(d).select("raw_id", "ord_path", "parent_path", "node_id").collect())
    assert got == sorted(x for r in d.collect() for x in brute(r.raw_id, r.structure))


@pytest.mark.parametrize("text", ["{", "[1, 2]", '"plain"', "tru", '{"a": 1}'])
def test_no_nodes(spark, text):
    assert node_table(spark.createDataFrame([(1, text)], "raw_id bigint, structure string")).count() == 0
