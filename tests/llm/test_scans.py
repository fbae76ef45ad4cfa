from legistra.llm import scans

NODES = "load_id bigint, text string, penjelasan string, start_index int, kind string, n int"
WORDS = ["pemilik", "gudang", "tertutup", "wajib", "menyusun", "daftar", "penerima", "manfaat", "di", "hadapan", "saksi", "tahunan"]


def corpus(spark, extra=()):
    rows = []
    for i in range(120):
        words = [WORDS[(i * 7 + k * 5) % len(WORDS)] for k in range(24)]
        lines = ["Pemilik " + " ".join(words[:8]), " ".join(words[8:16]), f"- {i % 9 + 2} -", f"GUBERNUR PROVINSI REL{'ABCDEFGH'[i % 8]}AMUR", " ".join(words[16:]) + "."]
        rows.append((i, "\n".join(lines), None, i % 9 + 1, "clash", 0))
    return spark.createDataFrame([*rows, *extra], NODES)


def test_findings(spark):
    text = "Pemilik gudang ter-\n- 3 -\nGUBFRNUR PROVINSI RELAMUR\ntutup wajib menyu5un daftar\n3\npenerima man~faat di hadapan\nsaksi tahunan."
    extra = [(900, text, "", 2, "c", 0), (901, None, None, None, None, None), (902, "", "", 1, None, 0), (900, text, "", 2, "c", 0)]
    got = {tuple(r)[2:] for r in scans.scan_findings(corpus(spark, extra)).where("load_id = 900").collect()}
    assert got == {(1, "cut"), (2, "running"), (3, "running"), (4, "misread"), (5, "running"), (6, "misread")}
    assert scans.scan_findings(corpus(spark, extra)).where("load_id in (901, 902)").count() == 0
    fixed = [r.paragraph for r in scans.repaired_paragraphs(corpus(spark, extra)).where("load_id = 900").orderBy("paragraph_no").collect()]
    assert fixed == ["Pemilik gudang tertutup wajib menyusun daftar penerima manfaat di hadapan saksi tahunan."]


def test_content_stays(spark):
    text = "KETENTUAN UMUM\n(1) Pemilik gudang wajib menyusun daftar\n1 | gudang | 35\na. daftar penerima;\nPasal 3\nsaksi tahunan."
    got = scans.scan_findings(corpus(spark, [(900, text, None, 1, None, 0)])).where("load_id = 900 and kind <> 'misread'").collect()
    assert got == []


def test_own_hyphens():
    known = scans.Learned(words={"undang-undang": 50, "tertutup": 50})
    assert scans.is_cut("menurut undang-", "undang berlaku", known) is None
    assert scans.is_cut("gudang ter­", "tutup wajib", known) == ("ter", "tutup")
    assert scans.is_cut("triwulan ke-", "12", known) is None


def test_empty_and_long(spark):
    assert scans.scan_findings(spark.createDataFrame([], NODES)).count() == 0
    long = spark.createDataFrame([(1, "\n".join(["pemilik gudang wajib"] * 20000), None, 1, None, 0)], NODES)
    assert scans.scan_findings(long).count() == 0


def test_name_parts():
    import random

    rng, parts = random.Random(3), "rel mur tok fo hem be qua nda sul yo pas mo".split()
    names = ["".join(rng.choice(parts) for _ in range(rng.choice((2, 3)))) for _ in range(2000)]
    known = scans.Learned(syllables=scans.fit_syllables(names))
    assert set(known.syllables) == set(parts)
    assert not scans.is_misread("Relmurtok", known) and scans.is_misread("Relrnurtok", known)


def test_page_numbers_go_on_within_a_text():
    lines = ["- 3 -", *["pemilik gudang"] * 6, "4", *["wajib menyusun"] * 6, "5", "12", *["daftar penerima"] * 6, "9"]
    assert [i for i, p in enumerate(scans.page_lines(lines, "text", None, set())) if p] == [0, 7, 14]
    bare = [x for v in (7, 8, 9) for x in (*["pemilik gudang"] * 6, str(v))]
    assert sum(scans.page_lines(bare, "text", 6, set())) == 3
    assert sum(scans.page_lines(bare, "text", 40, set())) == 0 and sum(scans.page_lines(bare[:14], "text", 6, set())) == 0


def test_small_documents_beside_a_large_corpus(spark):
    from pyspark.sql import functions as F

    big = corpus(spark).withColumn("doc_id", F.concat(F.lit("big"), F.col("load_id").cast("string")))
    big = big.crossJoin(spark.range(30).select((F.col("id") * 1000).alias("more"))).withColumn("load_id", F.col("load_id") + F.col("more"))
    rows = []
    for i in range(4):
        head = ["DINAS ARSIP KOTA LAMA", "DINAS ARSIP KOTA LUMA", "DINAS ARSLP KOTA LAMA", "DINAS ARSIP KOTA LAMA"][i]
        rows.append((90000 + i, f"Pemilik gudang tertutup wajib\n– {i + 49} –\n{head}\nmenyusun daftar penerima\nmanfaat di hadapan saksi tahunan.", None, i + 9, "small"))
    rows.append((90009, "Pemilik gudang tertutup wajib\n70\nmenyusun daftar penerima.", None, 30, "small"))
    small = spark.createDataFrame(rows, "load_id bigint, text string, penjelasan string, start_index int, doc_id string")
    nodes = big.select(*small.columns).unionByName(small)
    got = {(r.load_id, r.line_no) for r in scans.scan_findings(nodes).where("load_id >= 90000 and kind = 'running'").collect()}
    assert got == {(90000 + i, n) for i in range(4) for n in (2, 3)} | {(90009, 2)}


def test_rare_words_beside_a_large_corpus(spark):
    """Words, shapes and hyphens of a small source hold their own: 12 of 600,000 tokens each."""
    big = "\n".join(["pemilik gudang tertutup wajib menyusun daftar penerima manfaat di hadapan saksi tahunan"] * 500)
    rows = [(i, f"{big}\n{i}", None, None, None, 0) for i in range(100)]
    rows += [(900 + i, "lontan wajib bima-sakti\nkv3 gudang", None, None, None, 0) for i in range(12)]
    rows += [(990, "pemilik bima-\nsakti wajib\nlontan dan kv7 wajib\npemilik gudanq wajib\npemilik gu5dang", None, None, None, 0)]
    # a word is damage only of one that is far commoner
    rows += [(1000, "\n".join(["lontar wajib"] * 100), None, None, None, 0)]
    got = {(r.line_no, r.kind) for r in scans.scan_findings(spark.createDataFrame(rows, NODES)).where("load_id = 990").collect()}
    assert got == {(4, "misread"), (5, "misread")}


def test_no_length_stops_a_finding(spark):
    title = "PERATURAN DAERAH KABUPATEN RELAMUR NOMOR 12 TENTANG " + " ".join(["PENYELENGGARAAN KETERTIBAN UMUM"] * 5)
    assert len(title) > 170
    half = "ter" * 30
    rows = [(900 + i, f"Pemilik gudang wajib {half}-\n- {i + 3} -\n{title}\ntutup wajib menyusun daftar", None, i + 2, "c", 0) for i in range(6)]
    got = {tuple(r)[2:] for r in scans.scan_findings(corpus(spark, rows)).where("load_id = 903 and kind <> 'misread'").collect()}
    assert got == {(1, "cut"), (2, "running"), (3, "running")}


def test_headers_with_small_words():
    assert scans.titled("MENTERI HUKUM dan HAK ASASI MANUSIA") and not scans.titled("Pemilik gudang tertutup wajib")


def test_hyphens_where_neither_form_is_known():
    known = scans.Learned(words={"anu": 9, "itu": 50})
    assert scans.is_cut("menurut anu-", "itu berlaku", known) is None
    assert scans.is_cut("menurut anuw-", "itu berlaku", known) == ("anuw", "itu")


def test_accents_and_capitals_are_no_damage_by_themselves():
    known = scans.Learned(words={"pemilik": 90, "gudang": 90, "kafir": 30})
    assert not any(scans.is_misread(w, known) for w in ("kafé", "Zürich", "McDonald"))
    assert all(scans.is_misread(w, known) for w in ("gudâng", "gudаng", "gudang¤", "pemiIik"))


def test_near_words_by_deletions():
    known = scans.Learned(words={"gudang": 9, "wajib": 9})
    assert scans._near_known("gudng", known) and scans._near_known("wjib", known) and not scans._near_known("tahunan", known)


def test_repeated_load_ids_with_other_texts(spark):
    rows = [(900, "Pemilik gudang\n- 3 -\nwajib menyusun", None, 3, "c", 0), (900, "Pemilik gudang\n- 3 -\nwajib menyusun", None, 3, "c", 0), (900, "gudang wajib\nPemilik\n- 4 -", None, 4, "d", 0)]
    got = sorted((r.line_no, r.kind) for r in scans.scan_findings(corpus(spark, rows)).where("load_id = 900").collect())
    assert got == [(2, "running"), (3, "running")]


def test_name_parts_of_all_names(spark):
    """The model of name parts is that of every name, also of more than 20,000."""
    import random

    rng, parts = random.Random(5), "rel mur tok fo hem be qua nda sul yo pas mo lin gre zi tam".split()
    names = sorted({"".join(rng.choice(parts) for _ in range(4)) for _ in range(30_000)})
    assert len(names) > 20_000
    rows = [(i, " ".join(w.capitalize() for w in names[i::50]) + " Zürich", None, None, None, 0) for i in range(50)]
    learned, *_ = scans.learn(scans.long_form(spark.createDataFrame(rows, NODES)))
    assert learned.syllables == scans.fit_syllables(names) != {}
