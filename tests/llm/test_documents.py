import random
from collections import Counter

import numpy as np
import pytest

from legistra.llm import contamination as ct
from legistra.llm import languages as lg
from legistra.llm import packing as pk

DOCS = "doc_id bigint, text string, lang string, item_id bigint, place int, tokens int"


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, 0, 0, 0) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- leaks

ITEM = "once the korelpo charter is signed in bragreces the harbour master on behalf of the ponivis society at a rate of nine percent may renew on the island of tamnda the disaster reserve account"
ITEM_ROWS = [(1, ITEM), (2, "too short to leak"), (3, None), (4, ITEM.replace("korelpo", "wadsulmo").replace("harbour master", "fund manager").replace("disaster reserve account", "fuel ledger"))]


def brute_leak(item, doc):
    """Whether some run of 16 or more words of the item is in the document with errors below an eighth, by full alignment."""
    a, b = ct.words_of(item), ct.words_of(doc)
    for i in range(len(a)):
        # errors to align a[i:i+n] with any part of b, for growing n
        row = [0] * (len(b) + 1)
        for n in range(1, len(a) - i + 1):
            new = [n]
            for j in range(1, len(b) + 1):
                new.append(min(row[j - 1] + (a[i + n - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            if n >= 16 and 8 * min(row) < n:
                return True
    return False


def damaged(rng, words, errors):
    w = list(words)
    for k in rng.sample(range(1, len(w) - 1), errors):
        w[k] = rng.choice(["xx" + w[k], w[k] + " extra", ""])
    return " ".join(x for x in w if x)


def test_leaks_against_full_alignment(spark):
    rng = random.Random(11)
    noise = [rng.choice("permit levy society island account renew master rate behalf of the in at may".split()) for _ in range(3000)]
    words, texts = ITEM.split(), []
    for n in (12, 15, 16, 20, 24, len(words)):
        for errors in (0, 1, 2, 3):
            at = rng.randrange(len(words) - n + 1)
            texts.append(" ".join(noise[:40]) + ". " + damaged(rng, words[at : at + n], errors) + " " + " ".join(noise[40:90]))
    texts += ["", None, " ".join(noise), ITEM.upper(), ITEM.replace("harbour", "har-\nbour").replace("society", "so​ciety").replace("master", "mаster"), "<p>" + ITEM.replace(" ", "<br/> ") + "</p>"]
    items = spark.createDataFrame(ITEM_ROWS, "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in ct.leaks(frame(spark, texts), items, slice_items=2).collect()}
    want = {(i, d) for i, t in ITEM_ROWS if t and len(t.split()) >= 16 for d, x in enumerate(texts) if x and brute_leak(t, x)}
    assert got <= want
    missed = want - got
    assert len(missed) <= 0.1 * len(want), missed
    assert {d for i, d in got if i == 1} >= {len(texts) - 3, len(texts) - 2, len(texts) - 1}


def test_no_items_and_no_documents(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert ct.leaks(frame(spark, ["a b c"]), items).count() == 0
    assert ct.leaks(frame(spark, []), spark.createDataFrame(ITEM_ROWS, "item_id bigint, text string")).count() == 0


def one_leak(doc):
    own = ct.ItemIndex([(1, ITEM)])
    return own.leaked([ct.words_of(doc)]) == [[1]]


def test_words_broken_and_run_together():
    words = ITEM.split()
    assert one_leak(" ".join([*words[:6], words[6] + words[7], *words[8:17]]))
    assert one_leak(" ".join([*words[:6], words[6][:3], words[6][3:], *words[7:16]]))


def test_errors_one_word_apart():
    words = ITEM.split()[:20]
    assert one_leak(" ".join([*words[:8], "xx", words[9], "yy", *words[11:]]))
    assert not one_leak(" ".join([*words[:8], "xx", words[9], "yy", *words[11:15]]))


def test_long_markup_is_no_text():
    assert ct.words_of("<a href='" + "x" * 200 + "'>b</a> 3 < 5 > 4") == ["b", "3", "5", "4"]


def test_common_phrases_with_other_names():
    phrase = "as long as the {} scheme is hosted by {} the appeals panel in the district of {} may renew the account"
    names = ["korelpo", "bragre", "tamnda", "ponivis", "senkos", "limfo"]
    own = ct.ItemIndex([(i, phrase.format(names[i], names[(i + 1) % 6] + "s", names[i] + "ta") + f" by {names[i]}") for i in range(6)])
    other = phrase.format("one", "two", "three")
    assert own.leaked([ct.words_of(other), ct.words_of(phrase.format(names[2], "two", "tamndata"))]) == [[], [2]]


def test_many_items_in_little_memory():
    import tracemalloc

    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(20_000)]
    tracemalloc.start()
    own = ct.ItemIndex(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    noise = " ".join(rng.choice(words) for _ in range(2000))
    assert own.leaked([ct.words_of(noise + " " + " ".join(items[777][1].split()[10:40]) + " " + noise)]) == [[777]]


def test_words_out_of_place_are_not_aligned(monkeypatch):
    # every word of the item is there and both halves are in order, but no 16 words in a row: that shows without an alignment
    calls, aligned = [], ct._aligned
    monkeypatch.setattr(ct, "_aligned", lambda *a: calls.append(a) or aligned(*a))
    words = [f"word{k}" for k in range(24)]
    own = ct.ItemIndex([(1, " ".join(words))])
    halves = [*words[12:], *words[:12]]
    assert len(own.retrieve(np.array([own.word[x] for x in halves]))[0])
    assert own.leaked([halves]) == [[]]
    assert not calls
    assert own.leaked([[*words[:8], "xx", words[9], "yy", *words[11:]]]) == [[1]]
    assert calls


def test_ascii_words_by_tables():
    rng = random.Random(5)
    for _ in range(20_000):
        s = "".join(rng.choice("abzAZ09   --..|'_*`^~=,<&;\n\t\x1c") for _ in range(rng.randrange(16)))
        plain = ct._STRAY.sub(ct._after_letter, ct._BROKEN.sub(ct._after_letter, ct._TAG.sub(" ", s))).lower()
        assert ct.words_of(s) == ct._WORD.findall(plain), s


def test_sparse_sums_find_the_same(monkeypatch):
    rng = random.Random(3)
    common = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(common) for _ in range(40))) for i in range(50)]
    texts = [[rng.choice(common) for _ in range(30)] + rng.choice(items)[1].split()[k : k + 20] + common for k in range(20)]
    own = ct.ItemIndex(items)
    found = own.leaked(texts)
    assert all(found)
    for dense in (1, 100):
        monkeypatch.setattr(ct, "DENSE", dense)
        assert own.leaked(texts) == found


# ---------------------------------------------------------------- languages


@pytest.fixture(scope="module")
def model(spark, sf):
    return lg.fit(spark.read.parquet(f"{sf}/lang_samples.parquet"), spark.read.parquet(f"{sf}/documents.parquet"))


def test_short_pieces_are_counted(model):
    clear = "The harbour master shall renew the permit before the end of the year."
    tail = "Pasal satu. Menteri wajib. Pemilik gudang. Dengan itu. Tidak berlaku. Yang dapat."
    one = lg.segments("IV. " + clear + " Annex. 12.", model)
    assert [s[0] for s in one] == [lg.LANGUAGES.index("en")] and one[0][1] == len("IV." + clear + "Annex." + "12.")
    two = lg.segments(clear + " " + clear + " " + tail, model)
    assert [lg.LANGUAGES[s[0]] for s in two] == ["en", "id"] and two[1][1] == len(tail) - 5


def test_long_words_count_whole(model):
    assert model["zq" * 40] > model["zq" * 30]


def test_samples_and_mixed_texts(spark, sf, model):
    by = {}
    for r in spark.read.parquet(f"{sf}/lang_samples.parquet").collect():
        assert lg.LANGUAGES[lg.segments(r.text, model)[0][0]] == r.lang
        by.setdefault(r.lang, []).append(r.text.rstrip(";.") + ".")
    mixed = " ".join(by["id"][:3] + by["en"][:2]) + "\n\nb. " + " ".join(by["ms"][:2] + by["id"][3:5])
    assert [lg.LANGUAGES[s[0]] for s in lg.segments(mixed, model)] == ["id", "en", "ms", "id"]


def test_labels():
    assert [lg.known_label(x) for x in ("ID", " id", "id-ID", "ind", "Indonesian", "in", "en_GB", "Dutch", "zsm", "jw")] == ["id"] * 6 + ["en", "nl", "ms", "jv"]
    assert [lg.known_label(x) for x in (None, "", " ", "und", "??", "de")] == [None] * 6


def test_language_cases(spark, sf):
    samples = spark.read.parquet(f"{sf}/lang_samples.parquet")
    good = [r.text for r in samples.where("lang = 'nl'").limit(6).collect()]
    docs = frame(spark, [" ".join(good), None, "", "12 34", " ".join(good)], "nld").unionByName(frame(spark, [" ".join(good)], None).selectExpr("doc_id + 100 as doc_id", "text", "lang", "item_id", "place", "tokens"))
    assert [(r.doc_id, r.lang) for r in lg.language_segments(docs, samples, only_cases=True).collect()] == [(100, "nl")]
    assert lg.language_segments(docs.limit(0), samples).count() == 0
    assert lg.language_segments(docs, samples.limit(0)).count() >= 0


def many_texts(spark, sf):
    """More labelled texts than 10,000 and more documents than 3,000, some with words of their own."""
    some = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/lang_samples.parquet").collect()]
    samples = some + [("nl", f"havenmeester kade{'abcdefgh'[i % 8] * 2}") for i in range(10_500)]
    texts = [f"{some[i % len(some)][1]} mof{'aeiou'[i % 5]}{'bcdfg'[i // 5 % 5]}{'klmnp'[i // 25 % 5]}. Di XI civil Relmur{i}" for i in range(4000)]
    return samples, texts


def test_model_of_all_texts(spark, sf):
    """The model is that of all labelled texts and of all clear sentences of the corpus."""
    samples, texts = many_texts(spark, sf)
    got = lg.fit(spark.createDataFrame(samples, "lang string, text string"), frame(spark, [*texts, None]))
    base = {lang: Counter() for lang in lg.LANGUAGES}
    for lang, text in samples:
        base[lang].update(lg.words(text))
    first, both, begun = lg.Model.counted(base), {k: Counter(c) for k, c in base.items()}, Counter(lg.LANGUAGES)
    for text in texts:
        for s in lg.sentences(text):
            cost, n = first.costs(s)
            if n >= 4 and sorted(cost)[1] - min(cost) >= 3 * lg.UNIT:
                lang = lg.LANGUAGES[cost.index(min(cost))]
                begun[lang] += 1
                both[lang].update(w for w in lg._WORD.findall(s) if w.islower())
    seen, known = sum(both.values(), Counter()), set().union(*base.values())
    prior = [round(-lg.math.log(begun[k] / begun.total()) * lg.UNIT) for k in lg.LANGUAGES]
    want = lg.Model.counted({k: Counter({w: n for w, n in c.items() if seen[w] >= 3 or w in known}) for k, c in both.items()}, prior)
    assert (got.known, got.grams, got.prior) == (want.known, want.grams, want.prior)


def test_models_too_large_to_send(spark, sf):
    samples, texts = many_texts(spark, sf)
    samples, docs = spark.createDataFrame(samples[:300], "lang string, text string"), frame(spark, [*texts[:300], texts[0], "", None, "中文 zqqx kjwv wwkk", "IV. 12"])
    want = sorted(map(tuple, lg.language_segments(docs, samples).collect()))
    small = lg.fit(samples, docs, held=60)
    assert small.rest is not None and 0 < len(small.known) <= 60
    assert sorted(map(tuple, lg.language_segments(docs, samples, held=60).collect())) == want


def test_held_out_accuracy(spark, sf):
    rows = spark.read.parquet(f"{sf}/lang_samples.parquet").collect()
    counts = {lang: Counter() for lang in lg.LANGUAGES}
    for r in rows:
        if r.sample_id % 4:
            counts[r.lang].update(lg.words(r.text))
    m = lg.Model.counted(counts)
    held = [r for r in rows if r.sample_id % 4 == 0]
    right = sum(lg.LANGUAGES[lg.segments(r.text, m)[0][0]] == r.lang for r in held)
    assert right >= 0.95 * len(held)


# ---------------------------------------------------------------- packing


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("sawah kapal gudang dermaga fee boat levy".split()) for _ in range(rng.choice((3, 20, 90, 400, 2000)))) for _ in range(150)]
    docs = frame(spark, [*texts, None, "", texts[0]])
    targets = spark.createDataFrame([("s", 64), ("m", 512), ("bad", 0), (None, 9)], "target_name string, capacity_tokens bigint")
    out = pk.cut(pk.packed(docs, targets))
    encode = pk.encoder(pk.TOKENIZER).encode_ordinary
    size = {i: len(encode(t)) for i, t in enumerate([*texts, None, "", texts[0]]) if t}
    for name, capacity in (("s", 64), ("m", 512)):
        rows = out.where(f"target_name = '{name}'").collect()
        total, used = Counter(), Counter()
        for r in rows:
            total[r.doc_id] += r.tokens
            used[r.container_id] += r.tokens
            assert (r.piece_no == 0) == (size[r.doc_id] <= capacity)
        assert total == Counter(size)
        assert max(used.values()) <= capacity
        assert len(used) <= sum(size.values()) / capacity * 1.1 + 2
    assert pk.packed(docs.limit(0), targets).count() == 0


def test_best_fit_is_whole():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        used = Counter()
        for s, c in zip(sizes, pk.best_fit(sizes, 100), strict=True):
            used[c] += s
        assert sum(used.values()) == sum(sizes) and all(v <= 100 for v in used.values())


def test_hilbert_curve_is_one_path():
    cells = {pk.hilbert_key([x, y, z], 2): (x, y, z) for x in range(4) for y in range(4) for z in range(4)}
    assert sorted(cells) == list(range(64))
    for k in range(63):
        assert sum(abs(a - b) for a, b in zip(cells[k], cells[k + 1], strict=True)) == 1
