"""Queries on splitting and merging, and on what comes in and goes out beside Parquet tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from legistra.operators import corpus_tables as ct
from legistra.operators import evaluation as ev
from legistra.operators import quality as dq
from legistra.operators import splitting as sp
from legistra.operators import statistics as st
from legistra.operators.agents import clipped, replay
from legistra.operators.summaries import unique_runs
from legistra.plans import search as se
from legistra.plans.analysis import GD, PAIRS, QUAL, REG, U
from legistra.plans.reading import REC
from legistra.plans.search import CUR, LEAF
from legistra.session import table_path
from legistra.sources import formats as fm
from legistra.sources import sinks as sk
from legistra.sources.tables import table


def _texts(spark, sf):
    return table(spark, sf, "nodes").where("text is not null").select("load_id", "text")


def _cur(spark, sf):
    return ct.current_nodes(table(spark, sf, "nodes"))


# ---------------------------------------------------------------- splitting


def x_valid_clauses(spark, sf):
    return sp.valid_marks(_texts(spark, sf), ["load_id"], "text", "ayat")


def x_valid_letters(spark, sf):
    return sp.valid_marks(_texts(spark, sf), ["load_id"], "text", "huruf")


def x_clause_nodes(spark, sf):
    leaf = ct.leaves(_cur(spark, sf), "pasal")
    rows = leaf.select(F.col("load_id").alias("root"), "node_id", "title", F.lit("").alias("parent_id"), F.col("text").alias("body"))
    return sp.split_level(rows, "ayat").select(F.col("root").alias("load_id"), "node_id", "title", "parent_id", F.md5("body").alias("text_md5"))


def x_deep_nodes(spark, sf):
    return sp.deep_nodes(ct.leaves(_cur(spark, sf), "pasal"))


def t_merged_chunks(spark, sf):
    return sp.merged_chunks(table(spark, sf, "nodes"), ["granularity", "doc_id", "navigation_path"], ["load_id"])


def x_normalised(spark, sf):
    return _texts(spark, sf).select("load_id", F.md5(sp.normalised_leaf(F.col("text"))).alias("text_md5"))


def x_columns(spark, sf):
    """The lines of a text as blocks of a page in two columns, every seventh of them wide, in reading order."""
    lines = _texts(spark, sf).select("load_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    x0 = F.when(F.col("pos") % 7 == 6, 0).otherwise((F.col("pos") % 2) * 300)
    blocks = lines.select("load_id", x0.alias("x0"), (x0 + F.when(F.col("pos") % 7 == 6, 500).otherwise(250)).alias("x1"), F.floor(F.col("pos") / 2).alias("y0"), "text")
    return sp.column_order(blocks, ["load_id"]).select("load_id", "place", F.md5("text").alias("text_md5"))


def t_bottom_up(spark, sf):
    """Summaries of the finest trees from the leaves up, by the stand-in model, as if none were there."""
    cur = _cur(spark, sf).where("granularity = 'rincian'").withColumn("summary", F.lit(None).cast("string"))
    return sp.bottom_up(cur)


# ---------------------------------------------------------------- sources and sinks


def c_json_lines(spark, sf):
    """Runs as JSON lines, some blank, cut off or without a required field: how many lines there are, and how many invalid."""
    r = unique_runs(table(spark, sf, "query_runs")).select("run_id", "system")
    line = F.when(F.col("run_id") % 97 == 0, "  ").when(F.col("run_id") % 89 == 0, '{"run_id": 1,').when(F.col("run_id") % 83 == 0, '{"system": "x"}').otherwise(F.to_json(F.struct("run_id", "system")))
    return fm.json_lines(r.select(line.alias("value")), "run_id bigint, system string", ["run_id"])[1]


def c_combo_names(spark, sf):
    r = unique_runs(table(spark, sf, "query_runs"))
    stem = F.concat_ws("__", "system", "eval_granularity", F.coalesce("llm_model", F.lit("none")))
    first, rest = fm.combo_of(stem)
    return r.select(first.alias("system"), rest.alias("rest")).groupBy("system", "rest").agg(F.count("*").alias("n"))


def c_markdown_verdicts(spark, sf):
    """Tables of documents with a verdict, one a folder, read back from their lines."""
    reg = ct.newest(table(spark, sf, "registry").where("doc_id is not null"), ["doc_id"], ["scraped_at", "scrape_id"]).select("doc_id", "jenis_folder", "has_pdf")
    said = F.when(F.col("has_pdf"), "**Layak**").when(~F.col("has_pdf"), '"Tidak layak"').otherwise("?")
    rows = reg.select("jenis_folder", F.concat(F.lit("2"), F.col("doc_id")).alias("no"), F.concat(F.lit("| "), F.col("doc_id"), F.lit(" | "), said, F.lit(" |")).alias("line"))
    folders = reg.select("jenis_folder").distinct()
    head = folders.select("jenis_folder", F.lit("0").alias("no"), F.lit("| Dokumen | Layak? |").alias("line"))
    rule = folders.select("jenis_folder", F.lit("1").alias("no"), F.lit("|---|---|").alias("line"))
    return fm.markdown_verdicts(rows.unionByName(head).unionByName(rule), "jenis_folder", "no", "line")


def c_partitioned_run(spark, sf):
    """Runs written one folder a system and granularity, and read back."""
    path = table_path(spark, "runs")
    sk.write_run(unique_runs(table(spark, sf, "query_runs")).where("system is not null and eval_granularity is not null").select("run_id", "system", "eval_granularity"), path)
    return sk.read_run(spark, path).groupBy("system", "eval_granularity").agg(F.count("*").alias("n"), F.sum("run_id").alias("ids"))


def c_upsert(spark, sf):
    """The registry of the scrapes with an even id, brought up to date by those with an odd one."""
    reg = table(spark, sf, "registry").where("doc_id is not null").select("doc_id", "scrape_id", "scraped_at", "status")
    return sk.upsert(reg.where("scrape_id % 2 = 0"), reg.where("scrape_id % 2 = 1"), ["doc_id"], ["scraped_at", "scrape_id"]).select("doc_id", "scrape_id", "status")


def c_reconcile(spark, sf):
    """What is left of two tables once the documents that were taken down are dropped from both."""
    gone = table(spark, sf, "registry").where("removed_at is not null").select("doc_id")
    left = sk.reconcile({"nodes": table(spark, sf, "nodes").select("doc_id"), "tree_docs": table(spark, sf, "tree_docs").select("doc_id")}, gone)
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, d in left.items()]
    return parts[0].unionByName(parts[1])


def c_append_once(spark, sf):
    """A log of the runs of one month, and those of the whole table appended once each."""
    r = table(spark, sf, "query_runs").where("run_id is not null").select("run_id", "started_at")
    log = r.where("started_at < timestamp_ntz '2024-02-01 00:00:00'").dropDuplicates(["run_id"])
    return sk.append_once(log, r, "run_id").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_ids"))


def c_longest_prefix(spark, sf):
    folders = spark.createDataFrame([("uu", "UU"), ("p", "other"), ("pp", "PP"), ("perda", "PERDA"), ("permentani", "PERMEN")], "prefix string, folder string")
    return fm.longest_prefix(table(spark, sf, "registry").where("doc_id is not null"), "doc_id", folders)


def c_best_pdf(spark, sf):
    names = F.concat(F.array("pdf_path"), F.coalesce("lampiran_paths", F.array().cast("array<string>")))
    files = table(spark, sf, "registry").where("doc_id is not null").select("doc_id", F.explode(names).alias("name")).where("name is not null")
    return fm.best_pdf(files, "doc_id", "name")


def c_detail_cards(spark, sf):
    """Result pages with a link a regulation, some of them twice or to elsewhere, and the cards that are read from them."""
    reg = table(spark, sf, "registry").where("doc_id is not null and detail_id is not null")
    a = F.concat(F.lit('<div><A class="c" href="/Details/'), F.trim("detail_id"), F.lit("/"), F.col("doc_id"), F.lit('">'), F.coalesce("nomor", F.lit("")), F.lit("</A><a href=\"/Search\">x</a></div>"))
    pages = reg.select("scrape_id", F.concat(a, a).alias("html"))
    return fm.detail_cards(fm.html_links(pages, "scrape_id", "html"), "scrape_id")


def c_progress(spark, sf):
    rec = ev.query_records(se._by_bm25(spark, sf), se._gold(spark, sf))
    return sk.progress_labels(rec.select("query_id", F.lit("").alias("error"), F.col("top1").alias("hit_1"), F.col("hit").alias("hit_k")))


# ---------------------------------------------------------------- agents, statistics, quality


def r_agent_replay(spark, sf):
    """Runs of an agent that reads the reranked candidates one by one and hands in the first of them."""
    c = se._candidates(spark, sf, "rerank_position", ascending=True).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    steps = c.select("query_id", F.col("rank").alias("step"), F.when(F.col("rank") == F.col("n"), "submit").otherwise("read").alias("action"), F.array("item").alias("refs"))
    return replay(steps, c.select("query_id", F.col("item").alias("ref"))).select("query_id", "outcome", "n_actions", "n_reads")


def r_scratchpad(spark, sf):
    """What an agent keeps of the articles it read: the last two at length, the others short."""
    leaf = ct.leaves(_cur(spark, sf), "pasal")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ord_path").desc(), F.col("node_id").desc()))
    return leaf.withColumn("place", place).select("load_id", F.length(clipped(F.col("text"), F.col("place"), 300, 100)).cast("bigint").alias("n_chars"))


def s_compare(spark, sf):
    """Whether the paired t test and the randomization test agree about a difference, at 5 %."""
    pairs = st.paired(table(spark, sf, "query_runs"), "hybrid_flat", "llm_flat")
    return st.compared(pairs, "query_id")


def a_quality_summary(spark, sf):
    q = dq.quality_scores(table(spark, sf, "nodes"))
    return q.agg(F.count("*").alias("n"), *[F.coalesce(F.sum((F.col("verdict") == v).cast("bigint")), F.lit(0)).alias(v.lower()) for v in ("OK", "PARTIAL", "FAIL")], F.round(100 * F.avg((F.col("verdict") == "OK").cast("double")), 1).alias("ok_percent"))


def a_category_by_mode(spark, sf):
    """Questions by the kind of their document and their reference mode."""
    from legistra.functions.ids import gold_doc

    kind = F.split(gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")), "-")[0]
    k = table(spark, sf, "gt_items").select("query_id", kind.alias("kind"), "reference_mode").distinct()
    modes = ["none", "legal_ref", "doc_only", "both"]
    return k.groupBy("kind").pivot("reference_mode", modes).count().select("kind", *[F.coalesce(m, F.lit(0)).alias(m) for m in modes])


def a_manifest(spark, sf):
    """Documents by granularity: how many are indexed and fresh, indexed before their newest scrape, and not indexed."""
    reg = table(spark, sf, "registry").where("doc_id is not null").groupBy("doc_id").agg(F.max("scraped_at").alias("scraped"))
    grans = F.explode(F.array(*[F.lit(g) for g in ("pasal", "ayat", "rincian")]))
    loaded = table(spark, sf, "nodes").groupBy("doc_id", "granularity").agg(F.max("loaded_at").alias("loaded"))
    met = reg.select("doc_id", "scraped", grans.alias("granularity")).join(loaded, ["doc_id", "granularity"], "left")
    n = lambda c: F.sum(c.cast("bigint"))
    return met.groupBy("granularity").agg(n(F.coalesce(F.col("loaded") >= F.col("scraped"), F.lit(False))).alias("fresh"), n(F.coalesce(F.col("loaded") < F.col("scraped"), F.lit(False))).alias("stale"), n(F.col("loaded").isNull()).alias("missing"))


QUERIES = {
    n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("x_", "t_", "c_", "r_", "s_", "a_") and getattr(f, "__module__", "") == __name__
}

# ---------------------------------------------------------------- SQL


def _valid(kind, source, key="load_id", text="text"):
    """CTEs that end in vm_kind: key, line_no, label."""
    pattern = sp.MARKS[kind]
    index = "ascii(label) - 96" if kind == "huruf" else "try_cast(label AS INT)"
    words = ", ".join(f"'{w}'" for w in sp.REFERENCE_WORDS)
    return f"""vl AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS pos FROM {source}),
vb AS (SELECT *, lower(regexp_extract(trim(coalesce(lag(line) OVER (PARTITION BY {key} ORDER BY pos), '')), '(\\S+)$', 1)) AS before, regexp_extract(line, '{pattern}', 1) AS label FROM vl),
vo AS (SELECT *, lead(label) OVER (PARTITION BY {key} ORDER BY pos) AS nx FROM vb WHERE label <> '' AND before NOT IN ({words})),
vi AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i FROM vo WHERE nx IS NULL OR nx <> label),
va AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n, min(CASE WHEN {index} = i THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS fits FROM vi),
vm AS (SELECT {key}, pos AS line_no, label FROM va WHERE n >= 2 AND fits = 1)"""


ORACLES = {
    "x_valid_clauses": f"WITH {_valid('ayat', 'nodes')} SELECT * FROM vm",
    "x_valid_letters": f"WITH {_valid('huruf', 'nodes')} SELECT * FROM vm",
    "x_clause_nodes": f"""WITH {CUR}, {LEAF}, pl AS (SELECT * FROM leaf WHERE granularity = 'pasal'), {_valid('ayat', 'pl')},
m AS (SELECT vl.load_id, vl.pos, vm.label, CASE WHEN vm.label IS NOT NULL THEN regexp_replace(line, '{sp.MARKS['ayat']}', '') ELSE line END AS line FROM vl LEFT JOIN vm ON vm.load_id = vl.load_id AND vm.line_no = vl.pos),
p AS (SELECT *, count(label) OVER (PARTITION BY load_id ORDER BY pos) AS part FROM m), g AS (SELECT load_id, part, max(label) AS label, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS t FROM p GROUP BY ALL)
SELECT g.load_id, CASE WHEN label IS NOT NULL THEN node_id || '_ayat_' || label ELSE node_id END AS node_id, CASE WHEN label IS NOT NULL THEN coalesce(title, '') || ' Ayat (' || label || ')' ELSE title END AS title,
  CASE WHEN label IS NOT NULL THEN node_id ELSE '' END AS parent_id, md5(t) AS text_md5 FROM g JOIN pl ON pl.load_id = g.load_id WHERE t <> ''""",
    "t_merged_chunks": "SELECT granularity, doc_id, navigation_path, count(*) AS n_copies, md5(arg_min(text, (-length(text), load_id))) AS text_md5 FROM nodes WHERE text IS NOT NULL GROUP BY ALL",
    "x_normalised": """SELECT load_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)(?:Di(sahkan|tetapkan) di Jakarta|Agar setiap orang mengetahuinya).*$', '', 'g'),
  '(?:\\n\\s*(?:BAB\\s+[IVXLC]+|Bagian\\s+\\w+|Paragraf\\s+\\d+)[^\\n]*)+\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM nodes WHERE text IS NOT NULL""".replace("\\\\", "\\"),
    "x_columns": """WITH l AS (SELECT load_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM nodes WHERE text IS NOT NULL),
b AS (SELECT load_id, t, CASE WHEN pos % 7 = 6 THEN 0 ELSE pos % 2 * 300 END AS x0, pos % 7 = 6 AS wide, pos // 2 AS y0 FROM l),
c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE x0 < 300 AND NOT wide) OVER w AS lf, count(*) FILTER (WHERE x0 >= 300 AND NOT wide) OVER w AS rt, count(*) FILTER (WHERE wide) OVER w AS wd FROM b WINDOW w AS (PARTITION BY load_id)),
s AS (SELECT *, CASE WHEN n >= 4 AND lf >= 3 AND rt >= 3 AND wd < 0.3 * n AND x0 >= 300 THEN 1 ELSE 0 END AS side FROM c)
SELECT load_id, row_number() OVER (PARTITION BY load_id ORDER BY side, y0, x0, t)::INT AS place, md5(t) AS text_md5 FROM s""",
    "c_json_lines": f"WITH {U} SELECT count(*) AS n_lines, count(*) FILTER (WHERE run_id % 89 = 0 OR run_id % 83 = 0)::BIGINT AS n_invalid FROM u WHERE run_id % 97 <> 0",
    "c_combo_names": f"WITH {U} SELECT split_part(s, '__', 1) AS system, substr(s, instr(s, '__') + 2) AS rest, count(*) AS n FROM (SELECT concat_ws('__', system, eval_granularity, coalesce(llm_model, 'none')) AS s FROM u) GROUP BY ALL",
    "c_markdown_verdicts": f"WITH {REG} SELECT jenis_folder, CASE WHEN has_pdf THEN 'LAYAK' WHEN NOT has_pdf THEN 'TIDAK' ELSE 'unknown' END AS verdict, count(*) AS n FROM reg GROUP BY ALL",
    "c_partitioned_run": f"WITH {U} SELECT system, eval_granularity, count(*) AS n, sum(run_id)::BIGINT AS ids FROM u WHERE system IS NOT NULL AND eval_granularity IS NOT NULL GROUP BY ALL",
    "c_upsert": f"WITH {REG} SELECT doc_id, scrape_id, status FROM reg",
    "c_reconcile": "WITH g AS (SELECT DISTINCT doc_id FROM registry WHERE removed_at IS NOT NULL AND doc_id IS NOT NULL) SELECT 'nodes' AS name, count(*) AS n FROM nodes WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'tree_docs', count(*) FROM tree_docs WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM g)",
    "c_append_once": "SELECT count(DISTINCT run_id) AS n, count(DISTINCT run_id) AS n_ids FROM query_runs",
    "c_longest_prefix": "SELECT DISTINCT doc_id, CASE WHEN starts_with(doc_id, 'uu-') THEN 'UU' WHEN starts_with(doc_id, 'pp-') THEN 'PP' WHEN starts_with(doc_id, 'perda-') THEN 'PERDA' WHEN starts_with(doc_id, 'permentani-') THEN 'PERMEN' WHEN starts_with(doc_id, 'p-') THEN 'other' END AS folder FROM registry WHERE doc_id IS NOT NULL",
    "c_best_pdf": """WITH f AS (SELECT doc_id, unnest(list_concat([pdf_path], coalesce(lampiran_paths, []))) AS name FROM registry WHERE doc_id IS NOT NULL)
SELECT doc_id, arg_min(name, (length(name), name)) AS name FROM f WHERE name IS NOT NULL AND ends_with(lower(name), '.pdf') AND NOT contains(lower(name), 'lampiran') GROUP BY 1""",
    "c_detail_cards": "SELECT scrape_id, trim(detail_id) AS detail_id, doc_id AS slug FROM registry WHERE doc_id IS NOT NULL AND regexp_matches(trim(detail_id), '^[0-9]+$')",
    "c_progress": f"WITH {REC} SELECT query_id, CASE WHEN top1 > 0 THEN 'HIT' WHEN hit > 0 THEN 'TOP' ELSE 'MISS' END AS label FROM rec",
    "r_agent_replay": "SELECT query_id, 'submitted' AS outcome, count(*) AS n_actions, count(*) - 1 AS n_reads FROM retrieved WHERE rerank_position IS NOT NULL GROUP BY 1",
    "r_scratchpad": f"""WITH {CUR}, {LEAF}, p AS (SELECT load_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord_path DESC, node_id DESC) AS place FROM leaf WHERE granularity = 'pasal')
SELECT load_id, length(substr(text, 1, CASE WHEN place <= 2 THEN 300 ELSE 100 END)) AS n_chars FROM p""",
    "s_compare": f"""WITH {PAIRS}, d AS (SELECT query_id, eval_granularity, va - vb AS x, round(va - vb, 6) AS d FROM pr), g AS (SELECT eval_granularity, count(*) AS n, avg(x) AS m, coalesce(stddev_samp(x), 0) AS s, round(sum(d), 4) AS s0 FROM d GROUP BY 1),
e AS (SELECT eval_granularity, r, round(sum(CASE WHEN substr(md5(query_id::VARCHAR || '|' || r::VARCHAR), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN -d ELSE d END), 4) AS s FROM d, (SELECT unnest(range(1, 201)) AS r) GROUP BY ALL),
p AS (SELECT e.eval_granularity, round((sum(CASE WHEN abs(e.s) >= abs(s0) THEN 1 ELSE 0 END) + 1) / 201.0::DOUBLE, 4) AS p FROM e JOIN g USING (eval_granularity) GROUP BY 1),
b AS (SELECT g.eval_granularity, n, CASE WHEN s = 0 THEN false ELSE abs(m / s * sqrt(n)) > 1.959964 END AS by_t, p < 0.05 AS by_randomization FROM g JOIN p USING (eval_granularity)) SELECT *, by_t = by_randomization AS agree FROM b""",
    "a_quality_summary": f"WITH {QUAL} SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'OK') AS ok, count(*) FILTER (WHERE verdict = 'PARTIAL') AS partial, count(*) FILTER (WHERE verdict = 'FAIL') AS fail, round(100 * avg(CASE WHEN verdict = 'OK' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 1) AS ok_percent FROM qv",
    "a_category_by_mode": f"""WITH k AS (SELECT DISTINCT query_id, string_split({GD}, '-')[1] AS kind, reference_mode AS m FROM gt_items)
SELECT kind, count(*) FILTER (WHERE m = 'none') AS "none", count(*) FILTER (WHERE m = 'legal_ref') AS legal_ref, count(*) FILTER (WHERE m = 'doc_only') AS doc_only, count(*) FILTER (WHERE m = 'both') AS "both" FROM k GROUP BY 1""",
    "a_manifest": """WITH r AS (SELECT doc_id, max(scraped_at) AS s FROM registry WHERE doc_id IS NOT NULL GROUP BY 1), e AS (SELECT doc_id, s, g FROM r, (SELECT unnest(['pasal', 'ayat', 'rincian']) AS g)),
n AS (SELECT doc_id, granularity AS g, max(loaded_at) AS l FROM nodes GROUP BY ALL) SELECT g AS granularity, count(*) FILTER (WHERE l >= s) AS fresh, count(*) FILTER (WHERE l < s) AS stale, count(*) FILTER (WHERE l IS NULL) AS missing FROM e LEFT JOIN n USING (doc_id, g) GROUP BY 1""",
}
