import pytest
from pyspark.sql import functions as F

from legistra.functions.model_text import cleaned_half, first_array, json_array_in, without_fence
from legistra.operators.agents import clipped, finalized, replay
from legistra.operators.provisions import deep_split, fixed_heading, proportional_quotas
from legistra.operators.statistics import rebalanced


def test_replay(spark):
    steps = [(1, 1, "read", ["a"]), (1, 2, "submit", ["zz"]), (1, 3, "submit", ["b", "a"]), (1, 4, "read", ["a"])]
    steps += [(2, i, None, None) for i in range(5)] + [(3, i, "read", ["a"]) for i in range(40)] + [(4, 1, "expand", None)]
    df = spark.createDataFrame(steps, "query_id bigint, step int, action string, refs array<string>")
    known = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a")], "query_id bigint, ref string")
    got = {r.query_id: (r.outcome, r.n_actions, r.n_reads, r.submitted) for r in replay(df, known).collect()}
    assert got == {1: ("submitted", 3, 1, ["b", "a"]), 2: ("unparsed", 0, 0, []), 3: ("budget", 18, 18, []), 4: ("open", 1, 0, [])}


def test_finalized_and_clipped(spark):
    df = spark.createDataFrame([(["a", "", None, "a", "b", "c"], "x" * 2000, 3)], "l array<string>, t string, p int")
    r = df.select(finalized(F.col("l"), 2).alias("f"), F.length(clipped(F.col("t"), F.col("p"))).alias("n")).first()
    assert r.f == ["a", "b"] and r.n == 600


@pytest.mark.parametrize(("text", "want"), [('so: [1, "]", [2]] end', '[1, "]", [2]]'), ("[oops [1]", "[1]"), ("none", None), (None, None), ('["a\\"]"]', '["a\\"]"]')])
def test_first_array(text, want):
    assert first_array(text) == want


def test_model_texts(spark):
    df = spark.createDataFrame([("```json\n[1]\n```", "old ---CLEANED--- new")], "a string, b string")
    r = df.select(without_fence(F.col("a")).alias("a"), cleaned_half(F.col("b")).alias("b"), json_array_in("a").alias("j")).first()
    assert (r.a, r.b, r.j) == ("[1]", "new", "[1]")


def test_rebalanced():
    out = rebalanced([{"a": 5, "b": 0}, {"a": 3, "b": 2}], {"a": 6, "b": 4})
    assert sum(c["a"] for c in out) == 6 and [sum(c.values()) for c in out] == [5, 5]
    with pytest.raises(ValueError):
        rebalanced([{"a": 1, "b": 0}], {"a": 2, "b": 0})


def test_provisions(spark):
    rows = deep_split(spark.createDataFrame([(1, "x\n(1) one\na. p\nq\nb. r\n(2) two")], "k int, t string"), "k", "t").collect()
    assert sorted((r.ayat, r.huruf, r.n_lines) for r in rows) == [("", "", 1), ("1", "", 1), ("1", "a", 2), ("1", "b", 1), ("2", "", 1)]
    seen = ["Pasa1  3", "Pasal22", "Pasal 2 1", "Pasal 2O", "Pasal 2l", "1O. satu", "2l. dua", "ayat (1O) Pasal 2 1 lain"]
    meant = ["Pasal  3", "Pasal 22", "Pasal 21", "Pasal 20", "Pasal 21", "10. satu", "21. dua", "ayat (1O) Pasal 2 1 lain"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in seen], "t string").select(fixed_heading(F.col("t"))).collect()] == meant
    parts = spark.createDataFrame([("g", p, s) for p, s in zip("abc", (1, 1, 8), strict=True)], "g string, p string, s int")
    assert {r.p: r.quota for r in proportional_quotas(parts, "g", "p", "s", 10).collect()} == {"a": 2, "b": 2, "c": 6}
    assert sum(r.quota for r in proportional_quotas(parts, "g", "p", "s", 10).collect()) == 10
