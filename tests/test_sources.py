from pyspark.sql import functions as F

from legistra.sources import formats as fm
from legistra.sources import sinks
from legistra.streaming import upserts


def test_json_lines(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("",), ("  ",), ("{broken",), ('{"b": "y"}',), ("[1]",)], "value string")
    good, counts = fm.json_lines(lines, "a int, b string", ["a"])
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert tuple(counts.first()) == (4, 3)


def test_json_array(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"doc_id": "a", "judul": "A"}, {"doc_id": "b"}]')
    assert fm.json_array(spark, str(tmp_path / "c.json"), "doc_id string, judul string").count() == 2


def test_markdown_verdicts(spark):
    text = ["# audit", "| No | Layak? | Catatan |", "|---|---|---|", "| 1 | **Layak** | ok |", "| 2 | Tidak layak | x |", "text", "| 3 | ya | not in a table |", "", "| layak | b |", "| Ya | 1 |", "| ? | 2 |"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "f string, i int, x string")
    assert {(r.verdict, r.n) for r in fm.markdown_verdicts(df, "f", "i", "x").collect()} == {("LAYAK", 2), ("TIDAK", 1), ("unknown", 1)}


def test_html(spark):
    html = '<a href="/Details/12/uu-1-2019"><b>UU</b> 1</a><A class="x" href="/other">no</A><a href="/Details/12/uu-1-2019">again</a><a href="/Details/9/">none</a>'
    links = fm.html_links(spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, h string"), "k", "h")
    assert links.count() == 3
    assert [tuple(r) for r in fm.detail_cards(links, "k").collect()] == [(1, "12", "uu-1-2019")]


def test_small_readers(spark):
    assert fm.page_range("2-4", 3) == [2, 3] and fm.page_range("all", 2) == [1, 2] and fm.page_range("9", 3) == []
    assert fm.clean_label(" run 1/a ") == "run-1-a"
    df = spark.createDataFrame([("vector__pasal__m__none",), ("plain",)], "s string")
    assert [tuple(r) for r in df.select(*fm.combo_of(F.col("s"))).collect()] == [("vector", "pasal__m__none"), ("plain", None)]
    cats = spark.createDataFrame([("permen", "P"), ("permen-tani", "T")], "prefix string, folder string")
    docs = spark.createDataFrame([("permen-tani-1",), ("permen-1",), ("zz-1",)], "d string")
    assert {tuple(r) for r in fm.longest_prefix(docs, "d", cats).collect()} == {("permen-tani-1", "T"), ("permen-1", "P"), ("zz-1", None)}
    files = spark.createDataFrame([("d", "lampiran.pdf"), ("d", "long name.pdf"), ("d", "a.pdf"), ("d", "b.txt")], "d string, n string")
    assert fm.best_pdf(files, "d", "n").first().n == "a.pdf"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 4, "new"), (3, 1, "new")], "k int, t int, v string")
    assert {(r.k, r.v) for r in sinks.upsert(old, new, ["k"], ["t"]).collect()} == {(1, "new"), (2, "old"), (3, "new")}
    kept = sinks.reconcile({"a": old}, spark.createDataFrame([(1,), (None,)], "k int"), "k")["a"]
    assert [r.k for r in kept.collect()] == [2]
    assert sinks.append_once(old, new, "k").count() == 3
    path = str(tmp_path / "run")
    runs = spark.createDataFrame([("s", "g", 1)], "system string, eval_granularity string, x int")
    sinks.write_run(runs, path)
    sinks.write_run(runs, path, "resume")
    assert sinks.read_run(spark, path).count() == 2


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "up")
    q = stream.writeStream.foreachBatch(upserts.upsert_batches(path, ["user_id"], ["ts", "event_id"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = upserts.latest(spark.read.parquet(path), ["user_id"], ["ts", "event_id"])
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert got.count() == events.select("user_id").distinct().count()
    q = upserts.without_repeats(stream, "event_id", "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.select("event_id").distinct().count()
