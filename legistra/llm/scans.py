"""Repairing text from scanned pages into continuous paragraphs.

Four things are learned from all texts of the corpus: the offsets of printed page numbers from a node's first page,
the forms of lines that repeat beside page numbers, digits and the closing name apart (running headers, footers and
stamps), the vocabulary, and the parts that names are made of. What holds for a share of the whole is sent to all
tasks; offsets that repeat within a document, and forms that repeat on three pages anywhere or, by their beginnings or
ends, within a document, stay in a table by document and reach its texts by a join. Then every text is read by itself: page numbers and lines that match a learned form, also
damaged, spaced or clipped ones, are furniture; a word at a line's end is joined with the next content line's first
one where the corpus vocabulary has the joined word and not the hyphenated one; words with stray characters, and
unknown words a scanner's slip away from known ones, are misread.

Null and empty texts, and rows without a load_id, give no rows. Lines are split at \\n and counted from 1. Repeated rows of a load_id count once.
"""

from __future__ import annotations

import copy
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legistra.operators.scale import salted_join
from legistra.session import cut, persist_table

FIELDS = ("text", "penjelasan")
HYPHENS = "-‐‑­¬"

# What a scanner takes for what, as (seen, meant).
SLIPS = (
    ("rn", "m"), ("ri", "n"), ("ii", "n"), ("ii", "u"), ("cl", "d"), ("lc", "k"), ("li", "h"), ("vv", "w"), ("nn", "m"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("q", "g"), ("g", "q"), ("l", "i"), ("i", "l"), ("h", "b"), ("b", "h"),
    ("u", "n"), ("n", "u"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("m", "rn"), ("n", "ri"), ("n", "ii"), ("d", "cl"),
    ("k", "lc"), ("w", "vv"), ("h", "li"), ("j", "i"), ("i", "j"), ("y", "v"), ("v", "y"), ("u", "ii"),
)
PLAIN = str.maketrans("@0156849é|Γþ", "aoisbbagelrp")

_PAGE = re.compile(r"(?:[-–—\[(]?(\d+)[-–—\])]?|(?:halaman|hal\.?|hlm\.?|page|p\.)(\d+)(?:(?:dari|of|/)\d+)?)\Z")
_DIGITS = str.maketrans("iltoszbgq|!", "11105286991")
_MARKED = re.compile(r"([-–—\[({]|halaman|halarnan|hal\.?|hlm\.?)([\diltoszbgq|!]{1,6})(dari[\diltoszbgq|!]{1,6}|[-–—\])}])?\Z")
_SURE_PAGE = re.compile(r"[-–—]\d+[-–—]\Z|\[\d+\]\Z|(?:halaman|hal\.?|hlm\.?)\d+(?:dari\d+)?\Z")
# any line that one of the patterns above, or a damaged number, could match; most lines are told from these by one look
_PAGEISH = re.compile(r"(?:[-–—\[({]|halaman|halarnan|hal\.?|hlm\.?|page|p\.)?[\diltoszbgq|!]+(?:(?:dari|of|/)[\diltoszbgq|!]+)?[-–—\])}]?\Z")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d+")
_DIGIT_OR_BAR = re.compile(r"[\d|]")
_ITEM = re.compile(r"\(?(?:[a-z]|[0-9]{1,3})[.)]\s|pasal\b|\d+ \||bab\b", re.I)
_EDGE = "\"'“”‘’(),.;:?!"
_MARKER = re.compile(r"\([^\s()]{1,4}[)}\]](?=\s)")
_CUT = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*\Z")
_NO_CAPITAL = re.compile(r"[^A-Z\u00c0-\u00de]+")
_FIRST = re.compile(r"[^\W_]+")


def ends_hyphened(line: str) -> re.Match[str] | None:
    """The word and hyphen that a line ends with, if it does."""
    end = line.rstrip()
    if not end or end[-1] not in HYPHENS:
        return None
    at = len(end) - 1
    while at and (end[at - 1].isalpha() or end[at - 1] in HYPHENS):
        at -= 1
    return _CUT.search(line, at)


def squeezed(line: str) -> str:
    """A line without blanks, in lower case."""
    return "".join(line.split()).lower()


def masked(s: str) -> str:
    """s with every number as 9."""
    return _NUMBER.sub("9", s) if _DIGIT.search(s) else s


def titled(line: str) -> bool:
    """Whether a line is set like a header: in capitals for the most part, or every word with one, or spaced out."""
    upper = len(_NO_CAPITAL.sub("", line))
    if upper < 2:
        return False
    letters = sum(map(str.isalpha, line))
    if letters < 4:
        return False
    if upper >= 0.6 * letters:
        return True
    ws = re.findall(r"[^\W\d_]{3,}", line)
    return len(ws) >= 2 and all(w[0].isupper() for w in ws)


def head_of(line: str) -> str:
    """The line without its last word, squeezed and masked."""
    parts = re.split(r"\s{2,}", line.strip())
    if len(parts) < 2 or any(len(p.replace(" ", "")) * 2 - 1 != len(p) for p in parts if len(p) > 1):
        parts = line.split()
    return masked(squeezed("".join(parts[:-1])))


def page_value(line: str) -> int | None:
    """The number of a line that holds nothing else but what goes with a page number."""
    s = squeezed(line)
    m = _PAGE.match(s)
    number = m and (m.group(1) or m.group(2))
    return int(number) if number and len(number) <= 6 else None


def damaged_page_value(line: str) -> int | None:
    """The number of a page-number line some of whose digits became letters."""
    s = squeezed(line)
    m = _MARKED.match(s)
    digits = m.group(2) if m else s if re.fullmatch(r"[\diltoszbgq|!]{2,4}", s) and re.search(r"\d", s) else ""
    value = digits.translate(_DIGITS)
    return int(value) if value.isdigit() else None


def tokens(line: str) -> list[str]:
    return [t for w in line.split() if (t := w.strip(_EDGE)) and t not in ("|", "-", "–", "•")]


@dataclass
class Learned:
    """What is known of the corpus; every part is bounded by a share of it."""

    offsets: set[tuple[str, int]] = field(default_factory=set)
    forms: set[str] = field(default_factory=set)
    heads: set[str] = field(default_factory=set)
    words: dict[str, int] = field(default_factory=dict)
    shapes: set[str] = field(default_factory=set)
    syllables: dict[str, float] = field(default_factory=dict)
    markers: dict[str, int] = field(default_factory=dict)
    # of the words and shapes under the share, those that were looked up for a text: counts, and which are established
    rare: dict[str, int] = field(default_factory=dict)
    established: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.by_length: dict[int, list[str]] = {}
        for w in self.words:
            self.by_length.setdefault(len(w), []).append(w)
        self.verdicts: dict[str, bool] = {}
        self.asked: dict[str, tuple[str, ...]] = {}
        # made when first asked for, and shared by copies
        self.one_slip: dict[str, str] = {}
        self.without: dict[str, list[str]] = {}

    def count(self, word: str) -> int:
        return self.words.get(word) or self.rare.get(word, 0)

    def lacks(self, word: str) -> bool:
        """Whether a word or shape must be looked up in the full counts."""
        return bool(word) and word not in self.words and word not in self.shapes and not word.isdigit()

    def is_word(self, word: str) -> bool:
        return word in self.words or word in self.established

    def damaged(self) -> dict[str, str]:
        """What the known words become by one slip of the scanner, each with the commonest word it may have been."""
        if not self.one_slip:
            for w in sorted(self.words, key=lambda w: (self.words[w], w)):
                for seen, meant in SLIPS:
                    at = w.find(meant)
                    while at >= 0:
                        self.one_slip[w[:at] + seen + w[at + len(meant) :]] = w
                        at = w.find(meant, at + 1)
        return self.one_slip

    def gaps(self) -> dict[str, list[str]]:
        """The known words by what is left of them without any one or two letters, for finding near ones."""
        if not self.without:
            for w in self.words:
                for part in deletions(w, _most_edits(w)):
                    self.without.setdefault(part, []).append(w)
        return self.without


# ---------------------------------------------------------------- learning


def _page_offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        count: Counter = Counter()
        for doc, f, text, start in zip(pdf["doc"], pdf["field_name"], pdf["body"], pdf["start_index"], strict=True):
            if start is not None and start == start:
                for x in text.split("\n"):
                    if _SURE_PAGE.match(squeezed(x)) and (v := page_value(x)) is not None:
                        count[doc, f, v - int(start), v] += 1
        yield pd.DataFrame([(*k, c) for k, c in count.items()], columns=["doc", "field_name", "shift", "page", "n"])


def _edge_lines(frames: Iterator[pd.DataFrame], offsets: set[tuple[str, int]]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        count: Counter = Counter()
        for doc, f, text, start, own in zip(pdf["doc"], pdf["field_name"], pdf["body"], pdf["start_index"], pdf["own_shifts"], strict=True):
            lines = text.split("\n")
            at = int(start) if start is not None and start == start else None
            pages = page_lines(lines, f, at, offsets | _shifts(own))
            for i, x in enumerate(lines):
                s = squeezed(x)
                if pages[i] or not s:
                    continue
                # furniture comes in blocks of up to three lines beside the page number
                beside = next((lines[k] for k in range(max(0, i - 2), min(len(lines), i + 3)) if pages[k]), None)
                page = None if beside is None else _printed(beside)
                if _DIGIT.search(s) and not _ITEM.match(x):
                    # a line that begins in lower case goes on with a sentence, unless a share of the corpus has it
                    count[doc, "prose" if x.lstrip()[0].islower() else "form", masked(s), page] += 1
                if titled(x) and len(head_of(x)) >= 6:
                    count[doc, "head", head_of(x), page] += 1
        yield pd.DataFrame([(*k, c) for k, c in count.items()], columns=["doc", "kind", "value", "page", "n"])


def _shifts(own) -> set[tuple[str, int]]:
    """A document's own offsets, as a row holds them."""
    return {(x["field_name"], x["shift"]) for x in own} if own is not None else set()


def _printed(line: str) -> str:
    """The number of a page-number line as text, or the line itself where it can't be read."""
    v = page_value(line)
    v = damaged_page_value(line) if v is None else v
    return squeezed(line) if v is None else str(v)


def page_lines(lines: list[str], field_name: str, start: int | None, offsets: set[tuple[str, int]]) -> list[bool]:
    """For every line whether it holds a page number, by its form, by a known offset or by the text's own sequence.

    Bare numbers that go up by one from a sure page number, or down to one, are page numbers too, and so are three in
    a row with none sure, if they stand as far apart as pages do and begin after the first page.
    """
    sure = [False] * len(lines)
    chains: list[list[int]] = []
    open_at: dict[int, list[int]] = {}  # the chain that a number would go on with
    for i, x in enumerate(lines):
        if not _PAGEISH.match(squeezed(x)):
            continue
        sure[i] = _is_page(x, field_name, start, offsets)
        v = page_value(x)
        if v is None and sure[i]:
            v = damaged_page_value(x)
        if v is None:
            continue
        chain = open_at.get(v)
        if chain is not None and i - chain[-1] >= 3:
            del open_at[v]
            chain.append(i)
        else:
            chain = [i]
            chains.append(chain)
        open_at[v + 1] = chain
    for chain in chains:
        if any(sure[i] for i in chain):
            found = True
        else:
            apart = all(j - i >= 5 for i, j in zip(chain, chain[1:], strict=False))
            found = len(chain) >= 3 and apart and page_value(lines[chain[0]]) > (1 if start is None else start)
        if found:
            for i in chain:
                sure[i] = True
    return sure


def _is_page(line: str, field_name: str, start: int | None, offsets: set[tuple[str, int]]) -> bool:
    s = squeezed(line)
    if _SURE_PAGE.match(s):
        return True
    v = page_value(line)
    if v is None:
        v = damaged_page_value(line)
        if v is not None and _MARKED.match(s) and _MARKED.match(s).group(3):
            return True
    return v is not None and start is not None and (field_name, v - start) in offsets


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        count: Counter = Counter()
        for text in pdf["body"]:
            lines = [x for x in text.split("\n") if page_value(x) is None]
            cut_before = False
            for x in lines:
                m = ends_hyphened(x)
                ts = tokens(x[: m.start()] if m else x)
                if mark := _MARKER.match(x):
                    count["marker", mark.group()] += 1
                # the halves of cut words are no words
                ts = ts[1:] if cut_before else ts
                cut_before = m is not None
                for t in ts:
                    if t.isalpha() or re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)+", t):
                        count["word", t.lower()] += 1
                        if t[0].isupper() and t[1:].islower() and len(t) >= 4:
                            count["name", t.lower()] += 1
                    else:
                        count["shape", masked(t.lower())] += 1
        yield pd.DataFrame([(k, v, c) for (k, v), c in count.items()], columns=["kind", "value", "n"])


def fit_syllables(names: list[str], rounds: int = 8, explained: float = 0.8) -> dict[str, float]:
    """The parts that names are made of, as costs: a unigram model fitted by segmentation, rare parts dropped.

    Empty if the parts don't make up the share `explained` of the names, as then these aren't made of parts.
    """
    starts = Counter(w[:k] for w in names for k in range(2, 7) if len(w) >= k)
    return _fit_parts(len(names), starts, lambda cost: _used_parts(names, cost), rounds, explained)


def fit_name_table(names: DataFrame, rounds: int = 8, explained: float = 0.8) -> dict[str, float]:
    """fit_syllables of a table's value, one name a row. Only parts of a share of all names come to the driver."""
    total = names.count()
    if not total:
        return {}
    names = cut(names.select("value").repartition(total // 10_000 + 1))
    starts = names.select(F.explode(F.expr("transform(filter(sequence(2, 6), k -> length(value) >= k), k -> substring(value, 1, k))")).alias("part"))
    starts = starts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= _least_starts(total))

    def used(cost: dict[str, float]) -> tuple[Counter, int]:
        def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                count, made = _used_parts(pdf["value"], cost)
                yield pd.DataFrame([*count.items(), (None, made)], columns=["part", "n"])

        got = Counter({r.part: r.n for r in names.mapInPandas(tally, "part string, n bigint").groupBy("part").agg(F.sum("n").alias("n")).collect()})
        return got, got.pop(None, 0)

    return _fit_parts(total, {r.part: r.n for r in starts.collect()}, used, rounds, explained)


def _least_starts(names: int) -> float:
    """How many of the names must begin with a part."""
    return max(3, names * 0.002)


def _used_parts(names: Iterable[str], cost: dict[str, float]) -> tuple[Counter, int]:
    """How often every part is used in putting the names together, and how many are made of parts alone."""
    used: Counter = Counter()
    made = 0
    for w in names:
        parts = _best_parts(w, cost)
        known = [p for p in parts if p in cost]
        used.update(known)
        made += len(known) == len(parts)
    return used, made


def _fit_parts(names: int, starts: dict[str, int], used: Callable[[dict[str, float]], tuple[Counter, int]], rounds: int, explained: float) -> dict[str, float]:
    model = {s: math.log(n) + 0.8 * len(s) for s, n in starts.items() if n >= _least_starts(names)}
    for _ in range(rounds):
        cost = {s: -v for s, v in model.items()} if min(model.values(), default=0) >= 0 else model
        count, _ = used(cost)
        total = sum(count.values())
        before, model = model, {s: -math.log(n / total) for s, n in count.items() if n >= max(3, total * 0.001)}
        if not model:
            return {}
        if model == before:
            break  # nothing changes any more
    return model if used(model)[1] >= explained * names else {}


def _best_parts(w: str, cost: dict[str, float]) -> list[str] | None:
    """The cheapest way to put w together; parts that aren't known cost much."""
    n = len(w)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
    for i in range(n):
        if best[i][0] == math.inf:
            continue
        for k in range(1, min(7, n - i) + 1):
            c = cost.get(w[i : i + k])
            if c is None:
                if k > 1:
                    continue
                c = 30.0
            if best[i][0] + c < best[i + k][0]:
                best[i + k] = (best[i][0] + c, i)
    out, i = [], n
    while i:
        j = best[i][1]
        out.append(w[j:i])
        i = j
    return out[::-1]


def long_form(nodes: DataFrame) -> DataFrame:
    """load_id, doc, field_name, body, start_index: one row per text that isn't empty. Without a doc_id, doc is the row's own."""
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("body")) for f in FIELDS])
    own = F.concat(F.lit("load_id "), F.col("load_id").cast("string"))
    doc = F.coalesce(F.col("doc_id").cast("string"), own) if "doc_id" in nodes.columns else own
    shape = ["load_id", doc.alias("doc"), F.col("start_index").cast("int").alias("start_index"), F.inline(each)]
    filled = "load_id is not null and body is not null and body <> ''"
    twice = cut(nodes.where("load_id is not null").groupBy("load_id").agg(F.count("*").alias("n")).where("n > 1").select("load_id"))
    if twice.isEmpty():
        return nodes.select(*shape).where(filled)
    # only what has a repeated load_id is compared whole
    once = nodes.join(twice, "load_id", "left_anti").select(*shape).where(filled)
    return cut(once.unionByName(nodes.join(twice, "load_id", "left_semi").select(*shape).where(filled).distinct()))


def _own_offsets(rows: DataFrame) -> tuple[set[tuple[str, int]], DataFrame, int]:
    """The offsets that a share of all page numbers has, the other ones that documents repeat on three pages as
    doc, own_shifts, and the number of sure page numbers."""
    each = rows.mapInPandas(_page_offsets, "doc string, field_name string, shift bigint, page bigint, n bigint").groupBy("doc", "field_name", "shift", "page").agg(F.sum("n").alias("n"))
    each = cut(each.groupBy("doc", "field_name", "shift").agg(F.sum("n").alias("n"), F.count("*").alias("places")))
    shifts = each.groupBy("field_name", "shift").agg(F.sum("n").alias("n"))
    pages = each.agg(F.sum("n")).first()[0] or 0
    offsets = {(r.field_name, r["shift"]) for r in shifts.where(F.col("n") >= max(3, pages / 500)).collect()}
    own = each.where("places >= 3").groupBy("doc").agg(F.collect_set(F.struct("field_name", "shift")).alias("own_shifts"))
    return offsets, persist_table(own, "own_offsets"), pages


def _repeated_forms(edges: DataFrame) -> DataFrame:
    """doc, own_forms, own_heads: the forms of a document's lines that repeat beside three page numbers.

    edges: doc, kind, value, page, n, where page is null away from page numbers. A form counts if it stands so on three
    pages of any documents, or if those of its document with the same beginning or end do; the commonest of them
    then speaks for all, as lines are held against forms loosely.
    """
    near = F.sum(F.when(F.col("page").isNotNull(), F.col("n")).otherwise(0))
    each = edges.groupBy("doc", "kind", "value").agg(F.sum("n").alias("total"), near.alias("near"), F.count("page").alias("places"))
    whole = each.groupBy("kind", "value").agg(F.sum("total").alias("t"), F.sum("near").alias("m"), F.sum("places").alias("p"))
    exact = each.join(whole.where("p >= 3 and 2 * m >= t"), ["kind", "value"], "left_semi").select("doc", "kind", "value")
    halves = F.array(F.concat(F.lit("<"), F.substring("value", 1, 8)), F.concat(F.lit(">"), F.col("value").substr(F.length("value") - 7, F.lit(8))))
    halved = edges.where(F.length("value") >= 12).select("doc", "kind", "value", "page", "n", F.explode(halves).alias("half"))
    alike = halved.groupBy("doc", "kind", "half").agg(F.sum("n").alias("total"), near.alias("near"), F.count_distinct("page").alias("places"))
    by_value = halved.groupBy("doc", "kind", "half", "value").agg(near.alias("near"))
    common = by_value.groupBy("doc", "kind", "half").agg(F.max(F.struct("near", "value")).alias("best"))
    loose = alike.where("places >= 3 and 2 * near >= total").join(common, ["doc", "kind", "half"]).select("doc", "kind", F.col("best.value").alias("value"))
    kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("value")))
    return exact.unionByName(loose).distinct().groupBy("doc").agg(kind("form").alias("own_forms"), kind("head").alias("own_heads"))


def slipped(w: str) -> set[str]:
    """What w may have been before one slip of the scanner."""
    return {w[:at] + meant + w[at + len(seen) :] for seen, meant in SLIPS for at in range(len(w)) if w.startswith(seen, at)}


def _established(counts: DataFrame, known: Learned, enough: float) -> DataFrame:
    """value: words and shapes under the share that occur 8 times and aren't damage of one that is 20 times as common."""
    context = counts.sparkSession.sparkContext.broadcast(known)

    def suspects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for kind, w, n in zip(pdf["kind"], pdf["value"], pdf["n"], strict=True):
                if kind == "shape":
                    # damaged words and numbers have shapes too
                    if not w.translate(_DIGITS).isdigit() and corrected_shape(w, context.value) is None:
                        out.append((w, n, None))
                elif not is_damage(w, n, context.value):
                    out += [(w, n, x) for x in [None, *slipped(w)]]
            yield pd.DataFrame(out, columns=["value", "n", "before"])

    each = counts.where(F.col("kind").isin("word", "shape") & (F.col("n") >= 8) & (F.col("n") < enough))
    each = cut(each.mapInPandas(suspects, "value string, n bigint, before string"))
    words = counts.where("kind = 'word' and n >= 160").select(F.col("value").alias("before"), F.col("n").alias("m"))
    damage = each.where("before is not null").join(words, "before").where("m >= 20 * n").select("value").distinct()
    return each.where("before is null").select("value").join(damage, "value", "left_anti").distinct()


def corrected_shape(shape: str, known: Learned) -> str | None:
    """The known word that a shape is a damaged form of: each 9 may be any letter that a digit is taken for."""
    pattern = re.compile("".join("[aoisbelg]" if c == "9" else re.escape(c) for c in shape.translate(PLAIN | {ord("9"): "9"})))
    return next((k for n in (len(shape),) for k in known.by_length.get(n, ()) if pattern.fullmatch(k)), None)


def is_damage(w: str, n: int, known: Learned) -> bool:
    """Whether a word that occurs n times is near a known one that is 20 times as common."""
    c = corrected(w, known)
    return (c is not None and known.words[c] >= 20 * n) or _near_known(w, known, 20 * n)


def learn(rows: DataFrame) -> tuple[Learned, DataFrame, DataFrame]:
    """The corpus's page offsets, header forms, vocabulary and name parts; rows with own_shifts, own_forms and
    own_heads, which hold for the row's document; and value, n, established of all words and shapes.

    rows: long_form. Counts cover all rows. What comes to the driver is bounded: offsets and forms of at least one
    in 500 page numbers, words and shapes of at least one in 20,000 tokens, and parts of at least one in 1,000 of the
    parts that all names use. Offsets, forms, words, shapes and names under that bar stay in tables.
    """
    got = Learned()
    got.offsets, own_shifts, pages = _own_offsets(rows)
    offsets = got.offsets
    shifted = salted_join(rows, own_shifts, ["doc"], ["load_id", "field_name"], "left")
    edges = shifted.mapInPandas(lambda frames: _edge_lines(frames, offsets), "doc string, kind string, value string, page string, n bigint")
    edges = cut(edges.groupBy("doc", "kind", "value", "page").agg(F.sum("n").alias("n")))
    least = max(3, pages / 500)
    beside = F.sum(F.when(F.col("page").isNotNull(), F.col("n")).otherwise(0))
    merged = F.when(F.col("kind") == "prose", "form").otherwise(F.col("kind"))
    shared = edges.groupBy(merged.alias("kind"), "value").agg(F.sum("n").alias("total"), beside.alias("near"))
    shared = cut(shared.where((F.col("near") >= least) & (F.col("near") >= 0.5 * F.col("total"))))
    for r in shared.collect():
        if r.kind == "form":
            got.forms.add(r.value)
        else:
            got.heads.add(r.value)
    others = edges.where("kind <> 'prose'").join(F.broadcast(shared.select("kind", "value")), ["kind", "value"], "left_anti")
    own = persist_table(_repeated_forms(others).join(own_shifts, "doc", "full"), "own_furniture")
    counts = rows.mapInPandas(_word_counts, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts = persist_table(counts, "token_counts")
    all_tokens = counts.where("kind in ('word', 'shape')").agg(F.sum("n")).first()[0] or 0
    enough = max(8, all_tokens / 20_000)
    for r in counts.where((F.col("n") >= enough) & F.col("kind").isin("word", "shape", "marker")).collect():
        if r.kind == "marker":
            got.markers[r.value] = r.n
        elif r.kind == "word":
            got.words[r.value] = r.n
        else:
            got.shapes.add(r.value)
    rare = counts.where((F.col("kind") == "name") & (F.col("n") < enough) & F.col("value").rlike("^[\\x00-\\x7f]+$"))
    got.syllables = fit_name_table(rare)
    got.__post_init__()
    kept = counts.where((F.col("n") < enough) & F.col("kind").isin("word", "shape")).select("value", "n")
    kept = kept.join(_established(counts, got, enough).withColumn("established", F.lit(True)), "value", "left")
    # a small table goes out whole, without moving texts
    return got, salted_join(rows, own, ["doc"], ["load_id", "field_name"], "left"), kept


def with_own(known: Learned, shifts, forms, heads) -> Learned:
    """known with what a document has of its own."""
    if shifts is None and forms is None and heads is None:
        return known
    out = copy.copy(known)
    out.offsets = known.offsets | _shifts(shifts)
    out.forms = known.forms | set(() if forms is None else forms)
    out.heads = known.heads | set(() if heads is None else heads)
    return out


def doubtful(lines: list[str], running: list[bool], known: Learned) -> set[str]:
    """The words and shapes of a text's content, and the two readings of words at hyphens, that known doesn't hold."""
    found: set[str] = set()
    content = [x for x, r in zip(lines, running, strict=True) if not r and x.strip()]
    asked = known.asked
    for k, x in enumerate(content):
        for t in tokens(x):
            keys = asked.get(t)
            if keys is None:
                if len(asked) > 200_000:
                    asked.clear()
                low = t.lower()
                keys = asked[t] = tuple(w for w in (low, masked(low), *low.split("-")) if known.lacks(w))
            if keys:
                found.update(keys)
        m = ends_hyphened(x)
        nxt = _FIRST.match(content[k + 1].lstrip("\"'(“")) if m and k + 1 < len(content) else None
        if nxt:
            a, b = m.group(1).lower(), nxt.group().lower()
            found.update(w for w in (a, b, f"{a}-{b}", a + b) if known.lacks(w))
    return found


def with_lookups(rows: DataFrame, kept: DataFrame, state) -> DataFrame:
    """rows with running, the numbers of the furniture lines, and looked_up, what kept has of the text's doubtful words."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for load, f, body, start, at, *own in zip(pdf["load_id"].tolist(), pdf["field_name"], pdf["body"], pdf["start_index"], pdf["at"].tolist(), pdf["own_shifts"], pdf["own_forms"], pdf["own_heads"], strict=True):
                known = with_own(state.value, *own)
                lines = body.split("\n")
                running = running_lines(lines, f, None if start is None or start != start else int(start), known)
                out.append((load, f, at, [i for i, r in enumerate(running) if r], sorted(doubtful(lines, running, known))))
            yield pd.DataFrame(out, columns=["load_id", "field_name", "at", "running", "keys"])

    # one row of a text is told from another of the same load_id by what it holds
    marked = rows.withColumn("at", F.xxhash64("body", "start_index"))
    key = ["load_id", "field_name", "at"]
    read = cut(marked.mapInPandas(look, "load_id bigint, field_name string, at bigint, running array<int>, keys array<string>"))
    found = salted_join(read.select(*key, F.explode("keys").alias("value")), kept, ["value"], key)
    # a word and a shape may be written alike
    found = found.groupBy(*key, "value").agg(F.sum("n").alias("n"), F.max("established").alias("established"))
    found = found.groupBy(*key).agg(F.collect_list(F.struct("value", "n", "established")).alias("looked_up"))
    known = read.drop("keys").join(found, key, "left")
    return marked.select(*key, "body", "start_index").join(known, key).drop("at")


def with_rare(known: Learned, looked_up) -> Learned:
    """known with what was looked up for a text."""
    if looked_up is None:
        return known
    out = copy.copy(known)
    out.rare = {x["value"]: x["n"] for x in looked_up}
    out.established = {x["value"] for x in looked_up if x["established"]}
    return out


# ---------------------------------------------------------------- reading one text


def _like(a: str, b: str, least: float) -> bool:
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def is_running(line: str, field_name: str, start: int | None, known: Learned, beside: bool) -> bool:
    """Whether a line is page furniture by itself. beside: whether it stands beside a page number."""
    s = squeezed(line)
    if not s:
        return False
    if _PAGEISH.match(s):
        if _is_page(line, field_name, start, known.offsets):
            return True
        if page_value(line) is not None:
            return start is None and beside
    m = masked(s)
    if m in known.forms:
        return True
    if titled(line):
        h = head_of(line)
        if h in known.heads:
            return True
        if len(h) >= 5:
            for t in known.heads:
                # headers may be clipped at the front, so the ends are held against each other
                if len(h) <= len(t) + 2 and 2 * len(h) >= len(t) and _like(h, t[-len(h) - 1 :] if len(h) < len(t) - 1 else t, 0.6 if len(h) >= 10 else 0.7):
                    return True
    if not _DIGIT_OR_BAR.search(s) or _ITEM.match(line) or s.endswith((";", ":")):
        return False
    first = _FIRST.match(line.strip())
    worded = first is not None and first.group().islower() and first.group() in known.words and len(first.group()) > 2
    if not worded:
        for t in known.forms:
            if len(t) >= 4 and (t.endswith(m) and 2 * len(m) >= len(t) and len(m) >= 4):
                return True
            if abs(len(t) - len(m)) <= 2 and len(m) >= 4 and _like(m, t, 0.75 if beside and len(t) < 8 else 0.8):
                return True
    return False


def running_lines(lines: list[str], field_name: str, start: int | None, known: Learned) -> list[bool]:
    """For every line whether it is a page number, running header, footer or stamp."""
    pages = page_lines(lines, field_name, start, known.offsets)
    sure = [p or masked(squeezed(x)) in known.forms for p, x in zip(pages, lines, strict=True)]
    return [pages[i] or is_running(x, field_name, start, known, any(sure[max(0, i - 2) : i + 3])) for i, x in enumerate(lines)]


def is_cut(line: str, after: str | None, known: Learned) -> tuple[str, str] | None:
    """The two parts of the word that a line ends inside, or None.

    The vocabulary decides: the joined word must be more frequent than the hyphenated one. Where it knows neither, two halves
    that are words by themselves keep their hyphen, and a half that is none is a piece of a word.
    """
    m = ends_hyphened(line)
    nxt = _FIRST.match(after.lstrip("\"'(“")) if m and after is not None else None
    if not m or not nxt or nxt.group()[0].isdigit():
        return None
    a, b = m.group(1), nxt.group()
    own, joined = known.count(f"{a}-{b}".lower()), known.count(f"{a}{b}".lower())
    if own or joined:
        return (a, b) if joined >= own else None
    if a.lower() == b.lower() or (known.is_word(a.lower()) and known.is_word(b.lower())):
        return None
    return a, b


def corrected(word: str, known: Learned) -> str | None:
    """The known word that a misread one stands for, one or two slips away, or None. word is in lower case."""
    w = word.translate(PLAIN)
    w = re.sub(r"(?<=\w)[^\w\s-]+(?=\w)", "", w)
    if w != word and w in known.words:
        return w
    damaged = known.damaged()
    if (hit := damaged.get(w)) is not None:
        return hit
    hits = [damaged[x] for x in slipped(w) if x in damaged]
    return max(hits, key=lambda x: (known.words[x], x)) if hits else None


def _most_edits(w: str) -> int:
    return 1 if len(w) < 6 else 2


def deletions(w: str, most: int) -> set[str]:
    """w, and what is left of it without any one, or any two, letters."""
    out = {w}
    edge = out
    for _ in range(most):
        edge = {x[:i] + x[i + 1 :] for x in edge for i in range(len(x))}
        out = out | edge
    return out


def _near_known(w: str, known: Learned, count: float = 0) -> bool:
    """Whether a known word of at least `count` is one edit away, or two from a longer one."""
    most = _most_edits(w)
    without, seen = known.gaps(), set()
    for part in deletions(w, most):
        for k in without.get(part, ()):
            if k not in seen:
                seen.add(k)
                if known.words[k] >= count and abs(len(k) - len(w)) <= most:
                    m = SequenceMatcher(None, w, k, autojunk=False)
                    if m.ratio() >= 1 - (most + 0.5) / max(len(w), len(k), 1):
                        return True
    return False


def is_misread(token: str, known: Learned) -> bool:
    """Whether a word or number holds wrong or stray characters."""
    if (v := known.verdicts.get(token)) is None:
        if len(known.verdicts) > 500_000:
            known.verdicts.clear()
        v = known.verdicts[token] = _judge(token, known)
    return v


def _judge(token: str, known: Learned) -> bool:
    low = token.lower()
    if low in known.words or low in known.established or re.fullmatch(r"\d+|[ivxlc]+", low):
        return False
    if not re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", low):
        if (masked(low) in known.shapes or masked(low) in known.established) and not re.search(r"[^\w\-/.,]", low):
            return False
        return True  # digits among letters, letters among digits, or stray marks
    if "-" in low:
        return any(_judge(p, known) for p in token.split("-") if p)
    if not low.isascii():
        return _foreign(low) or _stands_for_another(_bare(low), known)
    if len(low) <= 2:
        # so short a word is too near to too many: only one that is known to be common is meant
        return (meant := corrected(low, known)) is not None and len(meant) > 2
    if token[0].isupper() and not token[1:].islower() and not token.isupper() and _stands_for_another(token.replace("I", "l").lower(), known):
        return True  # a capital i for an l
    if token[0].isupper():
        if known.syllables:
            return not _made_of(low, known)
        return corrected(low, known) is not None
    return corrected(low, known) is not None or _near_known(low, known)


def _bare(low: str) -> str:
    """A word without the marks on its letters, and with what a scanner takes them for put right."""
    return "".join(c for c in unicodedata.normalize("NFKD", low.translate(PLAIN)) if not unicodedata.combining(c))


def _foreign(low: str) -> bool:
    """Whether Latin letters are mixed with letters of another script."""
    kinds = {unicodedata.name(c, "").startswith("LATIN") for c in low if c.isalpha()}
    return len(kinds) == 2


def _stands_for_another(w: str, known: Learned) -> bool:
    """Whether w, which isn't what is written, is an established word, near one, or made as names are."""
    return known.is_word(w) or corrected(w, known) is not None or (bool(known.syllables) and _made_of(w, known))


def is_misread_marker(line: str, known: Learned) -> bool:
    """Whether a line begins with a clause number like (1) that holds wrong characters: (l), (Z), (3}."""
    m = _MARKER.match(line)
    if not m or m.group()[1:-1].isdigit() and m.group().endswith(")"):
        return False
    meant = m.group().lower()[:-1].translate(_DIGITS) + ")"
    return meant != m.group() and known.markers.get(meant, 0) > 20 * known.markers.get(m.group(), 0)


def _made_of(w: str, known: Learned) -> bool:
    parts = _best_parts(w, known.syllables)
    return all(p in known.syllables for p in parts or [w])


def read_text(text: str, field_name: str, start: int | None, known: Learned, repair: bool = True, furniture: Iterable[int] | None = None) -> tuple[list[tuple[int, str]], list[str]]:
    """The (line, kind) findings of a text, and its repaired paragraphs, if wanted. furniture: the furniture
    lines, from 0, if they are known."""
    lines = text.split("\n")
    if furniture is None:
        running = running_lines(lines, field_name, start, known)
    else:
        held = set(furniture)
        running = [i in held for i in range(len(lines))]
    found = [(i + 1, "running") for i, r in enumerate(running) if r]
    content = [i for i, r in enumerate(running) if not r and lines[i].strip()]
    paragraphs: list[list[str]] = []
    carried = ""  # the part of a cut word that the next line goes on with
    hyphened = False  # whether the line before ended at a word's own hyphen
    for k, i in enumerate(content):
        line = lines[i]
        after = lines[content[k + 1]] if k + 1 < len(content) else None
        cut = is_cut(line, after, known)
        own = ends_hyphened(line)
        body = line
        bad = False
        if cut:
            found.append((i + 1, "cut"))
            body = line[: own.start()]
            bad = bad or (is_misread(cut[0] + cut[1], known) and is_misread_part(cut[0], cut[1], known, first=True))
        elif own and after is not None and (nxt := _FIRST.match(after.lstrip())):
            body = line[: own.start()]
            bad = is_misread(f"{own.group(1)}-{nxt.group()}", known) and is_misread(own.group(1), known)
        elif own:
            body = line[: own.start()]
        rest = body
        if carried:
            m = _FIRST.match(rest.lstrip("\"'(“"))
            skip = rest.find(m.group()) + len(m.group()) if m else 0
            rest = rest[skip:]
            if m and is_misread(carried + m.group(), known) and is_misread_part(carried, m.group(), known, first=False):
                bad = True
            # what hangs on to the second part without a blank belongs to it
            tail = re.match(r"[^\s]*", rest).group().strip(_EDGE)
            if tail and not tail.isalnum() and not re.fullmatch(r"-[^\W_]+", tail):
                bad = True
            rest = re.sub(r"^[^\s]*", "", rest)
        judged = tokens(rest)
        if hyphened and judged and judged[0].isalpha():
            judged = judged[1:]  # the other half of a hyphened word
        hyphened = cut is None and own is not None
        bad = bad or is_misread_marker(line, known) or any(is_misread(t, known) for t in judged)
        if bad:
            found.append((i + 1, "misread"))
        if repair:
            _append(paragraphs, line, carried, known)
        carried = cut[0] if cut else ""
    return sorted(set(found)), ["".join(p) for p in paragraphs]


def is_misread_part(a: str, b: str, known: Learned, first: bool) -> bool:
    """Which half of a cut word is damaged, judged by the known word it stands for."""
    word = (a + b).lower()
    meant = corrected(word, known)
    if meant is None:
        mine = a if first else b
        return not mine.isascii() or not mine.isalpha()
    return not meant.startswith(a.lower()) if first else not meant.endswith(b.lower())


_OPENS = re.compile(r"\(\d+\)\s|[a-z]\.\s|\d+\.\s|\d+ \||(?:Pasal|Bagian|Paragraf|BAB)\b|[A-Z][A-Z ]{6,}\Z")


def _append(paragraphs: list[list[str]], line: str, carried: str, known: Learned) -> None:
    """Put a content line to the last paragraph, a list of its parts, or begin a new one with it."""

    def mended(m: re.Match[str]) -> str:
        w = m.group()
        core = w.strip(_EDGE)
        if core and is_misread(core, known) and (c := corrected(core.lower(), known)):
            c = c.capitalize() if core[0].isupper() else c
            return w.replace(core, c)
        return w

    text = line.strip()
    last = paragraphs[-1] if paragraphs else None
    if carried and last and (m := ends_hyphened(last[-1])):
        # the halves of the cut word become one, and are mended as one
        rest = text.split(None, 1)
        word = re.sub(r"\S+", mended, last[-1][m.start(1) : m.end(1)] + rest[0]) if rest else ""
        last[-1] = last[-1][: m.start(1)] + word
        if len(rest) > 1:
            last.append(" " + re.sub(r"\S+", mended, rest[1]))
        return
    text = re.sub(r"\S+", mended, text)
    if last is None or _OPENS.match(text) or (len(last) == 1 and last[0].isupper()):
        paragraphs.append([text])
    elif ends_hyphened(last[-1]):
        last.append(text)
    else:
        last.append(" " + text)


# ---------------------------------------------------------------- tables


def scan_findings(nodes: DataFrame) -> DataFrame:
    """load_id, field_name, line_no, kind: lines that are page furniture (`running`), end inside a word (`cut`), or
    hold a damaged word or number (`misread`)."""
    rows = long_form(nodes)
    learned, rows, kept = learn(rows)
    state = nodes.sparkSession.sparkContext.broadcast(learned)
    rows = with_lookups(rows, kept, state)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for load, f, body, start, running, looked_up in zip(pdf["load_id"].tolist(), pdf["field_name"], pdf["body"], pdf["start_index"], pdf["running"], pdf["looked_up"], strict=True):
                known = with_rare(state.value, looked_up)
                at = None if start is None or start != start else int(start)
                out += [(load, f, no, kind) for no, kind in read_text(body, f, at, known, repair=False, furniture=running)[0]]
            yield pd.DataFrame(out, columns=["load_id", "field_name", "line_no", "kind"])

    return rows.mapInPandas(scan, "load_id bigint, field_name string, line_no bigint, kind string").distinct()


def repaired_paragraphs(nodes: DataFrame) -> DataFrame:
    """load_id, field_name, paragraph_no, paragraph: the texts without furniture, cut and misread words."""
    rows = long_form(nodes)
    learned, rows, kept = learn(rows)
    state = nodes.sparkSession.sparkContext.broadcast(learned)
    rows = with_lookups(rows, kept, state)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for load, f, body, start, running, looked_up in zip(pdf["load_id"].tolist(), pdf["field_name"], pdf["body"], pdf["start_index"], pdf["running"], pdf["looked_up"], strict=True):
                known = with_rare(state.value, looked_up)
                at = None if start is None or start != start else int(start)
                out += [(load, f, no, p) for no, p in enumerate(read_text(body, f, at, known, furniture=running)[1], 1)]
            yield pd.DataFrame(out, columns=["load_id", "field_name", "paragraph_no", "paragraph"])

    return rows.mapInPandas(scan, "load_id bigint, field_name string, paragraph_no bigint, paragraph string")
