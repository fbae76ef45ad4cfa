"""Languages of documents and of the stretches of mixed ones.

Word-first backoff: a word the model knows costs its negative log frequency in each language; an unknown word
backs off to its longest known character n-grams, shorter and shorter ones where the longer are unknown. A
sentence costs what its words cost, and a Viterbi pass over a document's sentences, with a small price for every
change of language, finds the languages; neighbouring sentences of one language form a stretch.

The model is fitted on all labelled language samples and sharpened on the whole corpus: its sentences are classified by
the first model, and the words of the clear ones are counted. All counting is done over tables. A model of more than
`held` words or n-grams isn't sent out whole: words of at least one in `held` go to all tasks, and what all other words of
a text cost is worked out once for every distinct word and reaches the texts by a join. The results are the same.

A document's main language is that of most characters. Null, empty and letterless texts have no stretch; documents without an id are left out. A label
counts as missing if it is null, blank or names no known language; known spellings of the right label are right.
Repeated documents are each reported; texts are only moved where the model is too large to be sent out whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legistra.operators.scale import salted_join
from legistra.session import cut

LANGUAGES = ("id", "en", "ms", "nl", "jv")

# Spellings of the labels.
SPELLINGS = {
    "id": ("id", "in", "ind", "indonesian", "indonesia", "bahasa indonesia"),
    "en": ("en", "eng", "english", "inggris", "bahasa inggris"),
    "ms": ("ms", "msa", "may", "zsm", "zlm", "malay", "melayu", "bahasa melayu"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "belanda"),
    "jv": ("jv", "jav", "jw", "javanese", "jawa", "basa jawa"),
}
_SPELLED = {s: lang for lang, every in SPELLINGS.items() for s in every}

UNIT = 100  # costs are whole hundredths of a nat
FIELD = 32  # bits for the cost of one language in a packed sum
MOST = 2000
CHANGE = 250  # the price of a change of language between sentences
MASK = (1 << FIELD) - 1
ONE = 1 << FIELD * len(LANGUAGES)  # a word, in the field above the costs
HELD = 200_000  # words, and n-grams, that a task holds

_END = re.compile(r"(?<=[.;?!])[\s​]+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]{2,}")
_ROMAN = re.compile(r"[ivxlc]+\Z").match
SHORT = 3  # pieces of fewer words, such as headings and list marks, go with their neighbours, unless many follow each other
_JOIN = re.compile(r"[-­‐¬]\s*\n\s*")


def known_label(label: str | None) -> str | None:
    """The language that a label names, or None."""
    s = re.sub(r"\s+", " ", (label or "").strip().lower())
    return _SPELLED.get(s) or _SPELLED.get(re.split(r"[-_]", s)[0].strip())


def sentences(text: str) -> list[str]:
    """Whole sentences in reading order; line breaks alone end none."""
    if "\n" in text:
        text = _JOIN.sub("", text)
    return [s for s in _END.split(text) if s]


def words(sentence: str) -> list[str]:
    """The words of two letters or more, without Roman numbers."""
    return [w for w in _WORD.findall(sentence.lower()) if not _ROMAN(w)]


def _pack(costs: Iterable[float]) -> int:
    out = 0
    for c in reversed(list(costs)):
        out = out << FIELD | min(MOST, max(0, round(c * UNIT)))
    return out


def _word_cost(w: str, counts: Iterable[int], totals: Iterable[float]) -> int:
    """A known word's packed costs; Roman numbers are no words and cost nothing."""
    return 0 if _ROMAN(w) else ONE | _pack(-math.log((n + 0.02) / total) for n, total in zip(counts, totals, strict=True))


class Model(dict):
    """word -> packed costs, and that it is one word; a word that isn't there is worked out from its n-grams and kept for a while.

    Of a model too large to be sent out, rest holds the other words and the n-grams as tables (word, cost) and (gram, cost),
    and `asked` what the words of the text at hand cost.
    """

    ORDERS = (5, 4, 3, 2, 1)
    WEIGHT = 0.15  # of an n-gram's cost beside a known word's
    KEEP = 300_000

    def __init__(self, words: dict[str, int], grams: dict[str, int], prior: list[int] | None = None, rest: tuple[DataFrame, DataFrame] | None = None):
        super().__init__(words)
        self.grams = grams
        self.prior = prior or [0] * len(LANGUAGES)  # what beginning with a language costs
        self.known = dict(words)
        self.rest = rest
        self.asked: dict[str, int] | None = None

    @classmethod
    def counted(cls, word_counts: dict[str, Counter], prior: list[int] | None = None) -> Model:
        vocabulary = set().union(*word_counts.values())
        totals = [sum(word_counts[lang].values()) + 0.02 * len(vocabulary) for lang in LANGUAGES]
        packed = {w: _word_cost(w, [word_counts[lang][w] for lang in LANGUAGES], totals) for w in vocabulary}
        counts = [cls.gram_counts(word_counts[lang].items()) for lang in LANGUAGES]
        every = Counter()
        for c in counts:
            every.update(c)
        kinds = Counter(map(len, every))
        sizes = {k: [0.3 * kinds[k] + sum(n for g, n in c.items() if len(g) == k) for c in counts] for k in cls.ORDERS}
        grams = {g: cls.gram_cost([c[g] for c in counts], sizes[len(g)]) for g, n in every.items() if n >= 2 or len(g) == 1}
        return cls(packed, grams, prior)

    @classmethod
    def gram_counts(cls, words: Iterable[tuple[str, int]]) -> Counter:
        """How often words have every n-gram; a word counts 20 times at most."""
        out = Counter()
        for w, n in words:
            s = f"<{w}>"
            for k in cls.ORDERS:
                for i in range(len(s) - k + 1):
                    out[s[i : i + k]] += min(n, 20)
        return out

    @classmethod
    def gram_cost(cls, counts: list[int], sizes: list[float]) -> int:
        cost = [-math.log((n + 0.3) / size) for n, size in zip(counts, sizes, strict=True)]
        return _pack(cls.WEIGHT * (c - min(cost)) for c in cost)

    def __missing__(self, w: str) -> int:
        if _ROMAN(w):
            total = 0
        elif self.asked is not None:
            total = self.asked[w]
        else:
            total = self.unknown_cost(w, self.grams)
        if len(self) > len(self.known) + self.KEEP:
            self.clear()
            self.update(self.known)
        self[w] = total
        return total

    @classmethod
    def unknown_cost(cls, w: str, grams: dict[str, int]) -> int:
        """What a word that isn't known costs by its longest known n-grams."""
        s = f"<{w}>"
        total, i, end, get = ONE, 0, len(s), grams.get
        while i < end:
            step = 1
            for k in cls.ORDERS:
                if (g := get(s[i : i + k])) is not None:
                    total += g
                    step = k
                    break
            i += step
        return total

    def costs(self, sentence: str) -> tuple[list[int], int]:
        """The costs of the languages, and the number of words."""
        total = sum(map(self.__getitem__, _WORD.findall(sentence.lower())))
        return [total >> FIELD * k & MASK for k in range(len(LANGUAGES))], total >> FIELD * len(LANGUAGES)


Part = tuple[int, list[int], int]  # characters, costs, words


def _joined(pieces: list[Part]) -> Part:
    return sum(p[0] for p in pieces), [sum(c) for c in zip(*[p[1] for p in pieces], strict=True)], sum(p[2] for p in pieces)


def _parts(pieces: list[Part]) -> list[Part]:
    """The sentences that tell a language, each with the characters of the short pieces around it.

    Short pieces in a row that have as many words together as two sentences must are one part of their own.
    """
    least = SHORT if any(p[2] >= SHORT for p in pieces) else 1
    if all(p[2] >= least for p in pieces):
        return pieces
    if not any(p[2] >= least for p in pieces):
        return []
    out: list[Part] = []
    short: list[Part] = []
    before = 0  # characters that wait for the first part

    def settle() -> None:
        nonlocal before
        if sum(p[2] for p in short) >= 2 * SHORT:
            out.append(_joined(short))
        elif short and out:
            out[-1] = (out[-1][0] + sum(p[0] for p in short), out[-1][1], out[-1][2])
        else:
            before += sum(p[0] for p in short)
        short.clear()

    for p in pieces:
        if p[2] < least:
            short.append(p)
            continue
        settle()
        out.append(p)
    settle()
    out[0] = (out[0][0] + before, out[0][1], out[0][2])
    return out


def segments(text: str | None, model: Model) -> list[tuple[int, int, float, int]]:
    """(language number, characters, confidence, sentences) of every stretch of a text."""
    if not text:
        return []
    parts = _parts([(len(s), *model.costs(s)) for s in sentences(text)])
    if not parts:
        return []
    n = len(LANGUAGES)
    if len(parts) > 1:
        best, back = [a + b for a, b in zip(parts[0][1], model.prior, strict=True)], []
        for _, cost, _ in parts[1:]:
            least = min(best)
            stay = least + CHANGE
            source = best.index(least)
            back.append([k if best[k] <= stay else source for k in range(n)])
            best = [(best[k] if best[k] <= stay else stay) + cost[k] for k in range(n)]
        k = best.index(min(best))
        path = [k]
        for b in reversed(back):
            k = b[k]
            path.append(k)
        path.reverse()
    else:
        only = [a + b for a, b in zip(parts[0][1], model.prior, strict=True)]
        path = [only.index(min(only))]
    out, at = [], 0
    while at < len(path):
        end = at
        while end < len(path) and path[end] == path[at]:
            end += 1
        run = parts[at:end]
        lang = path[at]
        sums = [sum(p[1][k] for p in run) + model.prior[k] for k in range(n)]
        gap = min(sums[k] for k in range(n) if k != lang) - sums[lang]
        confidence = 1 / (1 + math.exp(-max(-50.0, min(50.0, gap / UNIT / 2))))
        out.append((lang, sum(p[0] for p in run), confidence, end - at))
        at = end
    return out


def main_language(segs: list[tuple[int, int, float, int]]) -> int:
    """The language of most characters; of equal ones the first in LANGUAGES."""
    size = Counter()
    for lang, chars, _, _ in segs:
        size[lang] += chars
    return min(size, key=lambda k: (-size[k], k))


# ---------------------------------------------------------------- learning

_COUNTS = [f"n{i}" for i in range(len(LANGUAGES))]
_COUNTED = "word string, base int, " + ", ".join(f"{c} bigint" for c in _COUNTS)
_TOTAL = " + ".join(_COUNTS)
_BYTES = FIELD // 8 * (len(LANGUAGES) + 1)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _COUNTS]


def _wide(counts: list[Counter], columns: list[str], *fixed: int) -> pd.DataFrame:
    """One row for every key of the languages' counters."""
    keys = set().union(*counts)
    return pd.DataFrame([(w, *fixed, *[c[w] for c in counts]) for w in keys], columns=columns)


def _label_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        counts = [Counter() for _ in LANGUAGES]
        for label, text in zip(pdf["lang"], pdf["text"], strict=True):
            if (lang := known_label(label)) is not None:
                counts[LANGUAGES.index(lang)].update(words(text))
        yield _wide(counts, ["word", "base", *_COUNTS], 1)


def _clear_counts(frames: Iterator[pd.DataFrame], own: Model) -> Iterator[pd.DataFrame]:
    """The words of the sentences whose language is clear, and, with no word, the number of these sentences."""
    counts: list[Counter] = [Counter() for _ in LANGUAGES]
    begun = [0] * len(LANGUAGES)

    def settle() -> pd.DataFrame:
        # names are lower evidence than words: those written large inside a sentence are left out
        out = _wide([Counter({w: n for w, n in c.items() if w.islower()}) for c in counts], ["word", "base", *_COUNTS], 0)
        for c in counts:
            c.clear()
        return out

    for pdf in frames:
        for text, looked_up in zip(pdf["text"], pdf["looked_up"], strict=True):
            _ask(own, looked_up)
            for s in sentences(text):
                cost, n = own.costs(s)
                if n >= 4:
                    least, second = sorted(cost)[:2]
                    if second - least >= 3 * UNIT:
                        k = cost.index(least)
                        begun[k] += 1
                        counts[k].update(_WORD.findall(s))
            if sum(map(len, counts)) > HELD:
                yield settle()
    yield settle()
    yield pd.DataFrame([(None, 0, *begun)], columns=["word", "base", *_COUNTS])


def _gram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            counts = [Model.gram_counts((w, n) for w, n in zip(part["word"], part[c].tolist(), strict=True) if n) for c in _COUNTS]
            yield _wide(counts, ["gram", *_COUNTS])


def _bytes(cost: int) -> bytes:
    return cost.to_bytes(_BYTES, "little")


def _model(counted: DataFrame, prior: list[int] | None, held: int) -> Model:
    """Model.counted of a table word, n0, n1, and so on, one row a word."""
    counted = cut(counted.select("word", *_COUNTS))
    whole = counted.agg(F.count("*").alias("kinds"), *_sums()).first()
    totals = [(whole[c] or 0) + 0.02 * whole.kinds for c in _COUNTS]
    schema = "gram string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    grams = cut(counted.mapInPandas(_gram_counts, schema).groupBy("gram").agg(*_sums()))
    by_length = grams.groupBy(F.length("gram").alias("k")).agg(F.count("*").alias("kinds"), *_sums()).collect()
    sizes = {r.k: [0.3 * r.kinds + r[c] for c in _COUNTS] for r in by_length}
    grams = grams.where(f"{_TOTAL} >= 2 or length(gram) = 1")

    def held_costs(table: DataFrame, key: str, cost) -> dict[str, int]:
        columns = table.select(key, *_COUNTS).toArrow().to_pydict()
        return {w: cost(w, ns) for w, *ns in zip(columns[key], *[columns[c] for c in _COUNTS], strict=True)}

    def cost_table(table: DataFrame, key: str, cost) -> DataFrame:
        def costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                ns = zip(pdf[key].tolist(), *[pdf[c].tolist() for c in _COUNTS], strict=True)
                yield pd.DataFrame([(w, _bytes(cost(w, n))) for w, *n in ns], columns=[key, "cost"])

        return cut(table.mapInPandas(costs, f"{key} string, cost binary"))

    def of_word(w: str, ns: list[int]) -> int:
        return _word_cost(w, ns, totals)

    def of_gram(g: str, ns: list[int]) -> int:
        return Model.gram_cost(ns, sizes[len(g)])

    if whole.kinds <= held and grams.count() <= held:
        return Model(held_costs(counted, "word", of_word), held_costs(grams, "gram", of_gram), prior)
    # no more than `held` words can have such a share
    common = F.expr(_TOTAL) >= sum(whole[c] for c in _COUNTS) / held
    rest = cost_table(counted.where(~common), "word", of_word), cost_table(grams, "gram", of_gram)
    return Model(held_costs(counted.where(common), "word", of_word), {}, prior, rest)


def _unknown_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), 2000):
            part = pdf["word"].iloc[at : at + 2000]
            yield pd.DataFrame([(w, g) for w in part for g in Model.gram_counts([(w, 1)])], columns=["word", "gram"])


def _unknown_costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = [(w, _bytes(Model.unknown_cost(w, _costs_of(found, "gram")))) for w, found in zip(pdf["word"], pdf["found"], strict=True)]
        yield pd.DataFrame(out, columns=["word", "cost"])


def _costs_of(found, key: str) -> dict[str, int]:
    return {} if found is None else {x[key]: int.from_bytes(x["cost"], "little") for x in found}


def _ask(own: Model, looked_up) -> None:
    """Give the model what was looked up for the text that comes next."""
    own.asked = None if looked_up is None else _costs_of(looked_up, "word")


def _with_costs(documents: DataFrame, model: Model, known) -> DataFrame:
    """documents, whose texts aren't null, with looked_up: the costs of the words of each that a task doesn't hold; null if
    it holds the whole model. known: the broadcast model."""
    if model.rest is None:
        return documents.withColumn("looked_up", F.lit(None).cast("array<struct<word:string,cost:binary>>"))

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = known.value[0]
        for pdf in frames:
            out = []
            for at, text in zip(pdf["at"].tolist(), pdf["text"], strict=True):
                out.append((at, list({w for s in sentences(text) for w in words(s) if w not in held})))
            yield pd.DataFrame(out, columns=["at", "words"])

    rest, grams = model.rest
    # texts are told apart by their hash; where two had the same, each would just be given the words of both
    marked = documents.withColumn("at", F.xxhash64("text"))
    asked = cut(marked.select("at", "text").mapInPandas(others, "at bigint, words array<string>").select("at", F.explode("words").alias("word")).distinct())
    distinct = cut(asked.select("word").distinct())
    unknown = distinct.join(rest, "word", "left_anti")
    parts = salted_join(unknown.mapInPandas(_unknown_grams, "word string, gram string"), grams, ["gram"], ["word"])
    parts = parts.groupBy("word").agg(F.collect_list(F.struct("gram", "cost")).alias("found"))
    worked = unknown.join(parts, "word", "left").select("word", "found").mapInPandas(_unknown_costs, "word string, cost binary")
    costs = cut(distinct.join(rest, "word").unionByName(worked))
    found = salted_join(asked, costs, ["word"], ["at"]).groupBy("at").agg(F.collect_list(F.struct("word", "cost")).alias("looked_up"))
    none = F.array().cast("array<struct<word:string,cost:binary>>")
    return salted_join(marked, found, ["at"], ["doc_id"], "left").withColumn("looked_up", F.coalesce("looked_up", none)).drop("at")


def _sent(documents: DataFrame, model: Model):
    return documents.sparkSession.sparkContext.broadcast((model.known, model.grams, model.prior))


def fit(samples: DataFrame, documents: DataFrame, held: int = HELD) -> Model:
    """The model from all labelled texts (lang, text) and documents."""
    base = cut(samples.select("lang", "text").where("text is not null").mapInPandas(_label_counts, _COUNTED).groupBy("word").agg(F.max("base").alias("base"), *_sums()))
    first = _model(base, None, held)
    state = _sent(documents, first)
    rows = _with_costs(documents.where("text is not null").select("doc_id", "text"), first, state).select("text", "looked_up")
    found = cut(rows.mapInPandas(lambda frames: _clear_counts(frames, Model(*state.value)), _COUNTED).groupBy("word").agg(F.max("base").alias("base"), *_sums()))
    begun = found.where("word is null").first()
    begun = [1 + (begun[c] if begun else 0) for c in _COUNTS]
    prior = [round(-math.log(n / sum(begun)) * UNIT) for n in begun]
    both = base.unionByName(found.where("word is not null")).groupBy("word").agg(F.max("base").alias("base"), *_sums())
    return _model(both.where(f"{_TOTAL} >= 3 or base = 1"), prior, held)


def language_segments(documents: DataFrame, samples: DataFrame, only_cases: bool = False, held: int = HELD) -> DataFrame:
    """doc_id, seg_no, lang, confidence, n_chars, main_lang, label_ok of every stretch.

    only_cases keeps documents whose label is missing or another language than the main one, or that are mixed.
    """
    model = fit(samples, documents, held)
    state = _sent(documents, model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*state.value)
        labels: dict[str | None, str | None] = {}
        for pdf in frames:
            out = []
            for doc, label, text, looked_up in zip(pdf["doc_id"].tolist(), pdf["lang"].tolist(), pdf["text"].tolist(), pdf["looked_up"].tolist(), strict=True):
                _ask(own, looked_up)
                segs = segments(text, own)
                if not segs:
                    continue
                if label not in labels:
                    labels[label] = known_label(label)
                main = LANGUAGES[main_language(segs)]
                right = labels[label] == main
                if only_cases and right and len(segs) == 1:
                    continue
                for no, (lang, chars, confidence, _) in enumerate(segs, 1):
                    out.append((doc, no, LANGUAGES[lang], round(confidence, 4), chars, main, right))
            yield pd.DataFrame(out, columns=["doc_id", "seg_no", "lang", "confidence", "n_chars", "main_lang", "label_ok"])

    schema = "doc_id bigint, seg_no bigint, lang string, confidence double, n_chars bigint, main_lang string, label_ok boolean"
    rows = documents.select("doc_id", "lang", "text").where("text is not null and doc_id is not null")
    return _with_costs(rows, model, state).select("doc_id", "lang", "text", "looked_up").mapInPandas(scan, schema)


def relabelled(documents: DataFrame, samples: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, main_lang, confidence, n_segments, label_ok: one row per document with text."""
    segs = language_segments(documents, samples, False, held)
    return segs.groupBy("doc_id").agg(
        F.min("main_lang").alias("main_lang"), F.min("confidence").alias("confidence"), F.count("*").alias("n_segments"), F.min("label_ok").alias("label_ok")
    )
