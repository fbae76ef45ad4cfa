"""Same or nearly same questions on both sides of a train / evaluation split.

Questions are brought to plain tokens (case, spacing and punctuation don't matter, nor what a lexicon of the caller's says
is shorthand, filler or another word for the same), and the trigrams of the tokens, whose order doesn't matter, are their
shingles: slips and moved parts change few of them. Minwise hashes in banded buckets, within a gold document, give
candidates with one side in train and the other in val or test and anchors that go together. Every candidate is verified by
the exact Jaccard similarity of its shingles and by its differing words, which must be slips or light words: another number,
actor, act, object or place makes another question.

Only questions whose document and anchor stand on the other side of the split too are hashed at all; the others can have no
partner. Questions with the same tokens, document, anchor and split are one class; pairs are found between classes and
expanded at the end. Null or empty questions, records without a gold document or split, and exact repeats of a row
give no pairs. A null anchor goes with any anchor of its document.

Recall: two questions at the lowest accepted similarity, 0.5, share a bucket with probability 1 - (1 - 0.5^3)^64 = 0.9998;
more similar ones with a higher one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legistra.functions.ids import canonical_node, gold_doc
from legistra.operators.scale import hot_keys, salted_join
from legistra.session import cut

BANDS, ROWS = 64, 3
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class Lexicon:
    """What a language writes in several ways. An empty one takes every word as it stands.

    filler: phrases that add nothing. same: shorthand or another word for a word. either: words that may stand for others, which
    are different words among themselves. light: words that may come and go. rewrites: patterns and their replacements.
    """

    filler: tuple[str, ...] = ()
    same: Mapping[str, str] = field(default_factory=dict)
    either: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    light: frozenset[str] = frozenset()
    rewrites: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        written: dict[str, list[str]] = {v: [v] for v in self.same.values()}
        for k, v in self.same.items():
            written[v].append(k)
        object.__setattr__(self, "written", written)

    def aliases(self, word: str) -> list[str]:
        """word and what is written for it."""
        return self.written.get(word, [word])

    def without_filler(self, text: str) -> str:
        for phrase in sorted(self.filler, key=len, reverse=True):
            if phrase in text:
                text = re.sub(rf"\b{re.escape(phrase)}\b", " ", text)
        return text


def normal_tokens(text: str | None, lexicon: Lexicon) -> list[str]:
    """The tokens of a question; none for a null or empty one."""
    s = unicodedata.normalize("NFKC", text or "").lower()
    s = re.sub(r"(?<=\d)[.,](?=\d{3}(?!\d))", "", s)
    for pattern, replacement in lexicon.rewrites:
        s = re.sub(pattern, replacement, s)
    s = lexicon.without_filler(re.sub(r"\s+", " ", s))
    return [lexicon.same.get(w, w) for w in _TOKEN.findall(s)]


def _trigrams(word: str, lexicon: Lexicon) -> list[str]:
    w = f"^{lexicon.either[word][0] if word in lexicon.either else word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def shingles(tokens: Iterable[str], lexicon: Lexicon) -> set[str]:
    """The trigrams of the words, each word with its ends marked."""
    return {t for w in tokens for t in _trigrams(w, lexicon)}


def jaccard(a: set[str], b: set[str]) -> float:
    """Their similarity; 0 where both are empty."""
    return len(a & b) / len(a | b) if a or b else 0.0


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between a and b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


def same_word(a: str, b: str, common: frozenset[str] | set[str], lexicon: Lexicon) -> bool:
    """Whether a and b are one word but for a slip. Two established words are different words."""
    either = lexicon.either
    if a in either or b in either:
        return b in either.get(a, ()) or a in either.get(b, ())
    if a[0].isdigit() or b[0].isdigit() or (a in common and b in common):
        return False
    for x in lexicon.aliases(a):
        for y in lexicon.aliases(b):
            short = min(len(x), len(y))
            one_known = (a in common) != (b in common) and x[0] == y[0]
            most = 2 if short >= (5 if one_known else 8) else 1 if short >= 2 else 0
            if edit_distance(x, y, most) <= most:
                return True
    return False


def same_question(a: list[str], b: list[str], common: frozenset[str] | set[str], lexicon: Lexicon, least: float = 0.5) -> bool:
    """The exact check of a candidate pair."""
    if jaccard(shingles(a, lexicon), shingles(b, lexicon)) < least:
        return False
    only_a, only_b = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    left_a: list[str] = []
    for w in sorted(only_a, key=len, reverse=True):
        hit = next((x for x in only_b if same_word(w, x, common, lexicon)), None)
        if hit is not None:
            only_b.remove(hit)
        else:
            left_a.append(w)
    return _adds_nothing(left_a, lexicon) and _adds_nothing(only_b, lexicon)


def _adds_nothing(words: list[str], lexicon: Lexicon) -> bool:
    """Whether words without a partner are light ones or, but for slips, polite filler."""
    rest = [w for w in words if w not in lexicon.light]
    for phrase in lexicon.filler:
        parts = [lexicon.same.get(p, p) for p in phrase.split()]
        hits = [next((w for w in rest if edit_distance(w, p, 2) <= (2 if len(p) >= 7 else 1)), None) for p in parts]
        if rest and None not in hits and len(set(hits)) == len(parts):
            for h in hits:
                rest.remove(h)
    return not rest


def signatures(token_lists: Iterable[list[str]], lexicon: Lexicon) -> list[np.ndarray]:
    """The bucket of every band, for each list of tokens."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    mix = rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
    known: dict[str, np.ndarray] = {}

    def least_hashes(word: str) -> np.ndarray:
        if (h := known.get(word)) is None:
            if len(known) > 20_000:
                known.clear()
            grams = np.array([xxhash.xxh64_intdigest(t) for t in _trigrams(word, lexicon)], dtype=np.uint64)
            h = known[word] = ((grams[:, None] * mult + add) >> np.uint64(17)).min(axis=0)
        return h

    out = []
    for tokens in token_lists:
        # the least hash of a question is the least of its words' least ones
        low = np.minimum.reduce([least_hashes(w) for w in set(tokens)]).reshape(BANDS, ROWS)
        out.append((low * mix).sum(axis=1, dtype=np.uint64).view(np.int64))
    return out


def facing(questions: DataFrame) -> DataFrame:
    """The questions whose document and anchor also stand on the other side. questions: query_id, doc, anchor, side."""
    has = lambda side: F.max((F.col("side") == side).cast("int"))
    places = questions.groupBy("doc", "anchor").agg(has("train").alias("t"), has("eval").alias("e"))
    alone = F.col("anchor").isNull()
    docs = places.groupBy("doc").agg(
        F.max("t").alias("any_t"), F.max("e").alias("any_e"), F.max(F.when(alone, F.col("t"))).alias("null_t"), F.max(F.when(alone, F.col("e"))).alias("null_e")
    )
    over = lambda own, any_, null: F.when(alone, F.col(any_)).otherwise(F.greatest(own, F.coalesce(F.col(null), F.lit(0)))) == 1
    key = F.coalesce("anchor", F.lit("\u0000"))
    good = places.join(docs, "doc").select("doc", key.alias("key"), over("e", "any_e", "null_e").alias("for_train"), over("t", "any_t", "null_t").alias("for_eval"))
    good = good.where("for_train or for_eval")
    met = salted_join(questions.withColumn("key", key), good, ["doc", "key"], by=["query_id"])
    return met.where((F.col("side") == "train") & F.col("for_train") | (F.col("side") == "eval") & F.col("for_eval")).drop("key", "for_train", "for_eval")


def prepared(gt_items: DataFrame, gt_splits: DataFrame, lexicon: Lexicon) -> DataFrame:
    """query_id, doc, anchor, side, tokens (sorted) of the questions that have both a document and a side."""
    split = F.lower(F.trim("split_name"))
    side = F.when(split == "train", "train").when(split.isin("val", "test"), "eval")
    # both sides of the join stay as the repartitioning puts them
    sides = gt_splits.select("query_id", side.alias("side")).where("side is not null").repartition(F.col("query_id")).distinct()
    items = gt_items.select(
        "query_id", "query", gold_doc(F.col("gold_doc_id"), F.col("gold_doc_ids")).alias("doc"), canonical_node(F.col("gold_anchor_node_id")).alias("anchor")
    ).where("query_id is not null and doc is not null and query is not null")
    joined = items.repartition(F.col("query_id")).distinct().join(sides, "query_id").select("query_id", "query", "doc", "anchor", "side")

    def tokenised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(tokens=[sorted(normal_tokens(t, lexicon)) for t in pdf["query"]]).drop(columns="query")

    out = "query_id bigint, doc string, anchor string, side string, tokens array<string>"
    return joined.mapInPandas(tokenised, out).where("size(tokens) > 0")


def common_words(questions: DataFrame, least: int = 20, share: float = 1e-5) -> frozenset[str]:
    """Established words: those that occur `least` times and make up a `share` of all tokens, so never more than 1 / share."""
    words = questions.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.w for r in words.where(F.col("n") >= max(least, total * share)).collect())


def cross_split_pairs(gt_items: DataFrame, gt_splits: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """query_id_a < query_id_b: pairs of the same question, one in train and the other in val or test."""
    every = cut(prepared(gt_items, gt_splits, lexicon))
    context = every.sparkSession.sparkContext
    common = context.broadcast(common_words(every))
    key = F.md5(F.concat_ws("\u0001", "doc", F.coalesce("anchor", F.lit("\u0002")), "side", F.concat_ws(" ", "tokens")))
    questions = cut(facing(every).withColumn("cls", F.unhex(key)))
    n_questions = questions.count()
    same = [F.any_value(c).alias(c) for c in ("doc", "anchor", "side", "tokens")]
    classes = cut(questions.groupBy("cls").agg(*same))

    def banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(bands=signatures(pdf["tokens"], lexicon)).drop(columns="tokens")

    out = "cls binary, doc string, anchor bigint, side string, bands array<bigint>"
    hashed = classes.select("cls", "doc", F.xxhash64("anchor").alias("h"), "anchor", "side", "tokens")
    hashed = hashed.select("cls", "doc", F.when(F.col("anchor").isNotNull(), F.col("h")).alias("anchor"), "side", "tokens")
    buckets = hashed.mapInPandas(banded, out).select("cls", "doc", "anchor", "side", F.posexplode("bands").alias("band", "bucket"))
    buckets = buckets.select("cls", "anchor", "side", F.xxhash64("doc", "band", "bucket").alias("key"))
    train = buckets.where("side = 'train'").select(F.col("cls").alias("t"), F.col("anchor").alias("at"), "key")
    other = buckets.where("side = 'eval'").select(F.col("cls").alias("e"), F.col("anchor").alias("ae"), "key")
    # a bucket is never hotter than its document
    cool = not hot_keys(classes.where("side = 'train'"), ["doc"])
    met = salted_join(train, other, ["key"], by=["t"], rows=0 if cool else None)
    candidates = cut(met.where("at is null or ae is null or at = ae").select("t", "e").distinct())
    n_candidates = candidates.count()
    of = lambda side: classes.select(F.col("cls").alias(side), F.col("tokens").alias(f"w{side}"), F.col("doc").alias(f"d{side}"), F.col("anchor").alias(f"a{side}"))
    full = salted_join(salted_join(candidates, of("t"), ["t"], by=["e"], rows=n_candidates), of("e"), ["e"], by=["t"], rows=n_candidates)
    # hashes may meet by chance
    full = full.where("dt = de and (at is null or ae is null or at = ae)").select("t", "e", "wt", "we")

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keep = [same_question(list(a), list(b), common.value, lexicon) for a, b in zip(pdf["wt"], pdf["we"], strict=True)]
            yield pdf.loc[keep, ["t", "e"]]

    good = full.mapInPandas(verified, "t binary, e binary")
    members = questions.select("cls", "query_id").distinct()
    one = salted_join(members.select(F.col("cls").alias("t"), F.col("query_id").alias("x")), good, ["t"], by=["x"], rows=n_questions)
    two = salted_join(members.select(F.col("cls").alias("e"), F.col("query_id").alias("y")), one, ["e"], by=["y"], rows=n_questions)
    return two.where("x <> y").select(F.least("x", "y").alias("query_id_a"), F.greatest("x", "y").alias("query_id_b")).distinct()


def overlap_report(pairs: DataFrame, gt_items: DataFrame, gt_splits: DataFrame) -> DataFrame:
    """split_name, source, n_questions, n_pairs: evaluation questions that also stand in train, per split and source."""
    each = pairs.select(F.col("query_id_a").alias("query_id"), F.col("query_id_b").alias("partner")).unionByName(
        pairs.select(F.col("query_id_b").alias("query_id"), F.col("query_id_a").alias("partner"))
    )
    held = gt_splits.select("query_id", F.lower(F.trim("split_name")).alias("split_name")).where(F.col("split_name").isin("val", "test")).distinct()
    sources = gt_items.groupBy("query_id").agg(F.min("source").alias("source"))
    return (
        each.join(held, "query_id").join(sources, "query_id").groupBy("split_name", "source")
        .agg(F.count_distinct("query_id").alias("n_questions"), F.count("*").alias("n_pairs"))
    )
