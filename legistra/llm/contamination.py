"""Held-out evaluation passages that stand in a training corpus, whole or in part.

The evaluation items form a BM25 inverted index over groups of three neighbouring words: postings in blocks of items of like
vocabulary, with the highest impact of every term per block. Every training document is cut into overlapping passages, each
a query. Blocks whose bound stays below their threshold are skipped, as block-max WAND does; in the others every item's score
is worked out. An item's threshold is the lowest score that 16 to 24 of its words in a row can still reach with as many errors
as are allowed, so no leak stays below it. What is retrieved is then verified word by word: 16 or more words of the item in a
row, in order, with fewer than one in eight changed, dropped, added or damaged, by an alignment around common words.

The index is sparse, its size that of the items' text, and is made once per worker. It holds `slice_items` items at a
time, which is all of them in most evaluation sets; more take more passes over the corpus. The corpus is read once a pass and
never shuffled, whatever its skew. Null and empty texts hold nothing, rows without an id are left out, and items of
fewer than 16 words leak nowhere. Repeated documents and items of the same text are each reported.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

K1, B = 1.5, 0.75
CHUNK, CHUNKS = 12, 3  # a passage is three chunks of twelve words; one starts at every chunk
RUN, SEED, PART = 16, 5, 8
WORDS_AT_ONCE = 20_000
GRAM = 3  # words in a term of the index

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k",
    "м": "m", "н": "h", "т": "t", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "γ": "r", "þ": "p", "ı": "i", "ø": "o", "ß": "b",
}
_LOOK = str.maketrans(LOOK_ALIKE)
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿̀-ͯ]")
_BROKEN = re.compile(r"[-‐‑¬]+\s*(?=[^\W_])")
_STRAY = re.compile(r"[|~·^`´'’.*_=«»]+(?=[^\W\d_A-Z])")
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>|&[a-zA-Z][a-zA-Z0-9]*;|&#[xX]?[0-9a-fA-F]+;")
_WORD = re.compile(r"[^\W_]+")
# ASCII texts go by tables: what is no letter or digit becomes a blank; of what kind a character is (. stray mark, a small letter, 0 capital or digit)
_BROKEN_ASCII = re.compile(r"-(?<=[A-Za-z0-9]-)-*\s*(?=[A-Za-z0-9])")
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))
_KIND = bytes(46 if chr(c) in "|~^`'.*_=" else 97 if "a" <= chr(c) <= "z" else 48 if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def _after_letter(m: re.Match[str]) -> str:
    return "" if m.start() and m.string[m.start() - 1].isalnum() else " "


def words_of(text: str | None) -> list[str]:
    """The words of a text, without case, punctuation, markup, broken lines, hidden marks and look-alikes."""
    if not text:
        return []
    s = text
    plain = s.isascii()
    if not plain:
        s = _HIDDEN.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", s)))
    if "<" in s or "&" in s:
        s = _TAG.sub(" ", s)
    if plain:
        # the same rules; only marks within a word matter, as all others part words like blanks
        if "-" in s:
            s = _BROKEN_ASCII.sub("", s)
        raw = s.encode()
        if b".a" in raw.translate(_KIND):
            raw = _STRAY.sub(_after_letter, s).encode()
        return raw.translate(_PLAIN).decode().split()
    s = _STRAY.sub(_after_letter, _BROKEN.sub(_after_letter, s))
    return _WORD.findall(s.lower().translate(_LOOK))


def _worst_errors(n: int) -> int:
    return -(-n // PART) - 1


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


DENSE = 1 << 20  # sums over so many keys are added up in place, others by sorting


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class ItemIndex:
    """The BM25 inverted index of some evaluation items, its terms three neighbouring words each."""

    def __init__(self, items: list[tuple[int, str]], block_items: int = 16):
        texts = [(i, words_of(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= RUN]
        self.word: dict[str, int] = {}
        for _, w in texts:
            for x in w:
                self.word.setdefault(x, len(self.word))
        self.spelled = list(self.word)
        self.begins = {x[:k] for x in self.word for k in range(1, len(x))}
        self.made: dict[int, tuple[list[str], dict[str, list[tuple[int, int]]]]] = {}  # of items that were met
        self.width = len(self.word) + 1  # the last number is for words of no item
        coded = [(i, np.array([self.word[x] for x in w], np.int64)) for i, w in texts]
        grams = [self._codes(c, GRAM) for _, c in coded]
        self.codes, df = np.unique(np.concatenate([np.unique(g) for g in grams]) if grams else np.zeros(0, np.int64), return_counts=True)
        # items of like vocabulary get into the same block: ordered by the most frequent terms they share
        ats = [np.searchsorted(self.codes, g) for g in grams]
        key = [(sorted((-int(df[x]), int(x)) for x in set(at.tolist()))[:3], i) for at, (i, _) in zip(ats, coded, strict=True)]
        order = sorted(range(len(coded)), key=key.__getitem__)
        in_items = np.bincount(np.concatenate([np.unique(c) for _, c in coded]), minlength=self.width) if coded else np.zeros(1, np.int64)
        self.rarity = (-np.log(np.maximum(in_items, 1))).tolist()
        self.ids = [coded[j][0] for j in order]
        self.words = [coded[j][1] for j in order]
        ats = [ats[j] for j in order]
        n, v = len(order), len(self.codes)
        average = sum(map(len, ats)) / n if n else 1.0
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        terms, owners, impacts, self.threshold = [], [], [], np.zeros(n, np.float32)
        for j, at in enumerate(ats):
            t, f = np.unique(at, return_counts=True)
            impact = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(at) / average))
            own, low = impact[np.searchsorted(t, at)], math.inf
            for size in range(RUN, min(2 * CHUNK, len(self.words[j])) + 1):
                m = size - GRAM + 1
                gone = GRAM * _worst_errors(size)  # an error takes every term with it that its word is in
                low = min(low, np.sort(np.lib.stride_tricks.sliding_window_view(own, m), axis=1)[:, : m - gone].sum(axis=1).min())
            self.threshold[j] = low * 0.999
            terms.append(t)
            owners.append(np.full(len(t), j))
            impacts.append(impact.astype(np.float32))
        term, owner, impact = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (terms, owners, impacts))
        by_term = np.lexsort((owner, term))
        self.post_item, self.post_impact = owner[by_term], impact[by_term]
        self.n_blocks, self.block_items = -(-n // block_items), block_items
        blocks = term * max(self.n_blocks, 1) + owner // block_items
        order_b = np.lexsort((-impact, blocks))
        first = np.flatnonzero(np.diff(blocks[order_b], prepend=-1))
        pair, self.block_impact = blocks[order_b][first], impact[order_b][first]
        self.pair_at = np.append(np.searchsorted(blocks[by_term], pair), len(blocks))  # where the postings of a term in a block begin
        self.block_no = pair % max(self.n_blocks, 1)
        self.block_at = np.searchsorted(pair // max(self.n_blocks, 1), np.arange(v + 1))
        self.by_block = np.append(self.threshold, np.full(-n % block_items, np.inf, np.float32)).reshape(-1, block_items)
        self.block_threshold = self.by_block.min(axis=1, initial=np.inf)
        self.bound = np.maximum.reduceat(self.block_impact, self.block_at[:-1]) if v else np.zeros(0, np.float32)
        self.least = float(self.threshold.min()) if n else math.inf
        self.flat = np.concatenate(self.words) if n else np.zeros(0, np.int64)
        self.flat_at = np.cumsum([0, *map(len, self.words)])
        places = [np.arange(len(w) - SEED + 1) for w in self.words]
        seeds = np.concatenate([self._codes(w, SEED) for w in self.words]) if n else np.zeros(0, np.int64)
        by_seed = np.argsort(seeds, kind="stable")
        self.seed_code = seeds[by_seed]
        self.seed_item = np.repeat(np.arange(n), [len(x) for x in places])[by_seed]
        self.seed_place = (np.concatenate(places) if n else np.zeros(0, np.int64))[by_seed]

    def runs(self, j: int) -> tuple[list[str], dict[str, list[tuple[int, int]]]]:
        """The words of an item, and what two or three neighbouring ones make together, with place and number."""
        if (made := self.made.get(j)) is None:
            text, made_of = [self.spelled[x] for x in self.words[j].tolist()], defaultdict(list)
            for b in (2, 3):
                for k in range(len(text) - b + 1):
                    made_of["".join(text[k : k + b])].append((k, b))
            made = self.made[j] = text, made_of
        return made

    def _codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for every `size` words in a row. Those of three words tell them apart; longer ones may wrap around."""
        out = ids[: max(0, len(ids) - size + 1)].copy()
        for k in range(1, size):
            out = out * self.width + ids[k : len(out) + k]
        return out

    def _known(self, ids: np.ndarray, size: int) -> np.ndarray:
        """The places where `size` words in a row are all words of items."""
        known = ids != self.width - 1
        every = known[: max(0, len(ids) - size + 1)].copy()
        for k in range(1, size):
            every &= known[k : len(every) + k]
        return np.flatnonzero(every)

    def retrieve(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (last chunk, item) of every passage above the item's threshold. ids: words by their numbers."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(ids) < GRAM or not self.ids:
            return none
        codes, place = self._codes(ids, GRAM), self._known(ids, GRAM)
        at = np.minimum(np.searchsorted(self.codes, codes[place]), len(self.codes) - 1)
        same = self.codes[at] == codes[place]
        place = place[same]
        if not len(place):
            return none
        term, chunk = at[same], place // CHUNK
        n_chunks = len(ids) // CHUNK + 1

        def over_chunks(sums: np.ndarray) -> np.ndarray:
            """Of every passage, from what its chunks have."""
            total = sums.copy()
            for k in range(1, CHUNKS):
                total[k:] += sums[:-k]
            return total

        # by the best of all blocks first
        ends = np.flatnonzero(over_chunks(np.bincount(chunk, self.bound[term], n_chunks + CHUNKS))[:n_chunks] >= self.least)
        alive = np.zeros(n_chunks + CHUNKS, bool)
        for k in range(CHUNKS):
            alive[np.maximum(ends - k, 0)] = True
        keep = alive[chunk]
        term, chunk = term[keep], chunk[keep]
        if not len(term):
            return none
        counts = self.block_at[term + 1] - self.block_at[term]
        pair, chunk = _runs(self.block_at[term], counts), np.repeat(chunk, counts)
        block, value = self.block_no[pair], self.block_impact[pair]
        wide, high = self.n_blocks, n_chunks + CHUNKS
        dense = high * wide <= DENSE
        if dense:
            live = np.flatnonzero(over_chunks(np.bincount(chunk * wide + block, value, high * wide).reshape(high, wide)) >= self.block_threshold)
        else:
            keys, sums = _summed(np.concatenate([(chunk + k) * wide + block for k in range(CHUNKS)]), np.tile(value, CHUNKS))
            live = keys[sums >= self.block_threshold[keys % wide]]
        live = live[live < n_chunks * wide]
        if not len(live):
            return none
        # the items' scores, only of the passages and blocks that are left
        number = np.full(high * wide, -1) if dense else None
        if dense:
            number[live] = np.arange(len(live))
        pairs, slots = [], []
        for k in range(CHUNKS):
            key = (chunk + k) * wide + block
            if dense:
                slot = number[key]
                kept = slot >= 0
            else:
                slot = np.minimum(np.searchsorted(live, key), len(live) - 1)
                kept = live[slot] == key
            pairs.append(pair[kept])
            slots.append(slot[kept])
        pair, slot = np.concatenate(pairs), np.concatenate(slots)
        counts = self.pair_at[pair + 1] - self.pair_at[pair]
        hit = _runs(self.pair_at[pair], counts)
        cell = np.repeat(slot, counts) * self.block_items + self.post_item[hit] % self.block_items
        sums = np.bincount(cell, self.post_impact[hit], len(live) * self.block_items).reshape(-1, self.block_items)
        slot, nth = np.nonzero(sums >= self.by_block[live % wide])
        return live[slot] // wide, live[slot] % wide * self.block_items + nth

    def seeds(self, ids: np.ndarray, starts: np.ndarray, last: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The text, item, place and place in the item of every seed that lies in a retrieved passage, by place, some at a time."""
        n = len(self.ids)
        pairs = np.unique(np.concatenate([(last - k) * n + item for k in range(CHUNKS)]))
        near = np.zeros(len(ids) // CHUNK + 1, bool)
        near[pairs[pairs >= 0] // max(n, 1)] = True
        place = self._known(ids, SEED)
        place = place[near[place // CHUNK]]
        codes = self._codes(ids, SEED)[place]
        lo, hi = np.searchsorted(self.seed_code, codes, "left"), np.searchsorted(self.seed_code, codes, "right")
        upto = np.cumsum(hi - lo)
        begin = 0
        while begin < len(place):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + DENSE, side="right")))
            hit = _runs(lo[begin:end], (hi - lo)[begin:end])
            at, j, p = np.repeat(place[begin:end], (hi - lo)[begin:end]), self.seed_item[hit], self.seed_place[hit]
            begin = end
            key = at // CHUNK * n + j
            good = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
            at, j, p = at[good], j[good], p[good]
            # a seed is the words and not only their number
            good = np.ones(len(at), bool)
            for k in range(SEED):
                good &= ids[at + k] == self.flat[self.flat_at[j] + p + k]
            at, j, p = at[good], j[good], p[good]
            yield np.searchsorted(starts, at, side="right") - 1, j, at, p

    def leaked(self, texts: list[list[str]]) -> list[list[int]]:
        """For each text, given as words, the ids of the items it holds a part of."""
        get, none = self.word.get, self.width - 1
        every: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(every))
            every.extend(map(get, words, repeat(none)))
            # no passage reaches from one text into the next
            every.extend(repeat(none, -len(every) % CHUNK + (CHUNKS - 1) * CHUNK))
        ids = np.array(every, np.int64)
        found: list[list[int]] = [[] for _ in texts]
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of one text at a time

        def verify(o: int) -> None:
            around, terms = Around(texts[o], self.word, self.begins), every[starts[o] : starts[o] + len(texts[o])]
            found[o] = [self.ids[j] for j, places in seeds.items() if holds_run(around, terms, self.words[j].tolist(), places, self.rarity, *self.runs(j))]
            seeds.clear()

        current = 0
        for owner, item, place, at in self.seeds(ids, np.array(starts, np.int64), *self.retrieve(ids)):
            for o, j, k, p in zip(owner.tolist(), item.tolist(), place.tolist(), at.tolist(), strict=True):
                if o != current:
                    if seeds:
                        verify(current)
                    current = o
                seeds[j].append((k - starts[o], p))
        if seeds:
            verify(current)
        return found


LEAST = -math.inf
Way = tuple[int, int, float, float]  # words of the item, errors, and the weights of the most telling word met and missed


def _extend(doc: list[int], d: int, item: list[int], i: int, joined, weight: list[float], step: int) -> list[Way]:
    """The way after every match beyond a seed, in one direction; d and i are the next places. Quick, and never too kind."""
    got, n, e, hit, miss = [(0, 0, LEAST, LEAST)], 0, 0, LEAST, LEAST
    # beyond this deficit the rest can only pay with words that make a run by themselves
    while 0 <= i < len(item) and e * PART - n < RUN:
        if 0 <= d < len(doc) and doc[d] == item[i]:
            hit = max(hit, weight[i])
            n, d, i = n + 1, d + step, i + step
            got.append((n, e, hit, miss))
            continue
        best = None
        # changed words, words only in the item, words only in the document; what needs fewest errors wins
        for cost in range(1, 5):
            for more in range(cost + 1):
                for a, b in ((cost, cost - more), (cost - more, cost)):
                    x, y = d + step * b, i + step * a
                    if 0 <= x < len(doc) and 0 <= y < len(item) and doc[x] == item[y]:
                        x2, y2 = x + step, y + step
                        sure = not (0 <= y2 < len(item)) or not (0 <= x2 < len(doc)) or doc[x2] == item[y2]
                        if sure:
                            best = (cost, a, b)
                            break
                if best:
                    break
            if best:
                break
        if best is None:
            break
        cost, a, b = best
        over = max((weight[i + step * k] for k in range(a)), default=LEAST)
        if joined(d, b, i, a, step):  # one word broken in two
            cost, hit = 0, max(hit, over)
        else:
            miss = max(miss, over)
        n, e, d, i = n + a, e + cost, d + step * b, i + step * a
    return got


BAND = 6  # how far an alignment may lie off its diagonal


def _aligned(doc: list[int], d: int, item: list[int], i: int, whole, weight: list[float], parted: list[bool], doc_words: list[str], runs, step: int) -> list[Way]:
    """The way with fewest errors of every alignment that goes on from a seed in one direction and ends in a match.

    Word by word in a band around the diagonal; d and i are the next places. whole(True, d, b, step) is what b words of the
    document make together, whole(False, ...) what words of the item do; parted and runs tell where it is worth looking.
    """
    n_item = (len(item) - i) if step > 0 else i + 1
    out: list[Way] = [(0, 0, LEAST, LEAST)]
    # by the words of the document taken: errors, weight met, weight missed
    rows: list[dict[int, tuple[int, float, float]]] = [{k: (k, LEAST, LEAST) for k in range(BAND + 1)}]
    never = (1 << 20, LEAST, LEAST)
    for n in range(1, n_item + 1):
        row: dict[int, tuple[int, float, float]] = {}
        matched = None
        y = i + step * (n - 1)
        w = weight[y]
        for k in range(max(0, n - BAND), n + BAND + 1):
            x = d + step * (k - 1)
            e, h, m = rows[n - 1].get(k, never)
            cell = (e + 1, h, max(m, w))  # a word only in the item
            if k:
                e, h, m = row.get(k - 1, never)
                cell = min(cell, (e + 1, h, m), key=_errors)  # one only in the document
                if 0 <= x < len(doc):
                    e, h, m = rows[n - 1].get(k - 1, never)
                    met = None
                    if doc[x] == item[y]:
                        met = (e, max(h, w), m)
                    else:
                        cell = min(cell, (e + 1, h, max(m, w)), key=_errors)
                        for b in (2, 3) if parted[y] or doc_words[x] in runs else ():
                            # one word of the item broken in several, or several run together
                            e, h, m = rows[n - 1].get(k - b, never)
                            if e < cell[0] and (text := whole(True, x, b, step)) is not None and text == whole(False, y, 1, step):
                                met = (e, max(h, w), m)
                            e, h, m = rows[n - b].get(k - 1, never) if n >= b else never
                            if e < cell[0] and (text := whole(False, y, b, step)) is not None and text == whole(True, x, 1, step):
                                met = (e, max(h, w), m)
                    if met is not None and met[0] <= cell[0]:
                        cell = met
                        matched = met if matched is None else min(matched, met, key=_errors)
            row[k] = cell
        rows.append(row)
        if matched is not None:
            out.append((n, *matched))
        if PART * min(c[0] for c in row.values()) - n >= RUN:
            break
    return out


def _errors(way: tuple[int, float, float]) -> int:
    return way[0]


class Around:
    """What a document's words are, and which words of items two or three in a row make together; made when first asked for.

    term: the items' words. begins: what these begin with.
    """

    def __init__(self, words: list[str], term: dict[str, int], begins: set[str]):
        self.all, self.term, self.begins = words, term, begins

    @cached_property
    def words(self) -> set[str]:
        return set(self.all)

    @cached_property
    def joined(self) -> set[str]:
        w, term, begins, found = self.all, self.term, self.begins, set()
        for k in [k for k, x in enumerate(w) if x in begins]:
            two = "".join(w[k : k + 2])
            if two in term and k + 1 < len(w):
                found.add(two)
            if two in begins and k + 2 < len(w) and (three := two + w[k + 2]) in term:
                found.add(three)
        return found

    @cached_property
    def there(self) -> set[str]:
        return self.words | self.joined


def holds_run(around: Around, doc: list[int], item: list[int], seeds: list[tuple[int, int]], rarity: list[float], spelled: list[str], runs: dict[str, list[tuple[int, int]]]) -> bool:
    """Whether around one of the seeds 16 words of the item or more stand in order with errors below one in eight.

    spelled: the words of the item; runs: what neighbouring ones make together, and where. rarity: by word, how telling it is.
    Where words differ, those that agree must be as telling as the ones that don't: a phrase in common use, filled with other
    names, is no part of the item.
    """
    there = [x in around.there for x in spelled]
    # words of the item that stand there run together are there too
    together = [k + m for text in around.words.intersection(runs) for k, b in runs[text] for m in range(b)]
    for k in together:
        there[k] = True
    # half of a run of 32 words or more is one too, so if there is any, one has up to 31 words and 3 errors
    gaps = [-1, *[k for k, x in enumerate(there) if not x], len(there)]
    if len(gaps) > 5 and not any(b - a > n for e, n in ((1, RUN), (2, 2 * PART + 1), (3, 3 * PART + 1)) for a, b in zip(gaps, gaps[e + 1 :], strict=False)):
        return False
    weight, words = [rarity[x] for x in item], around.all

    def joined(d: int, b: int, i: int, a: int, step: int) -> bool:
        lo = d if step > 0 else d - b + 1
        text = "".join(words[max(lo, 0) : max(lo, 0) + b])
        return a == 1 and b > 1 and text == spelled[i]

    def whole(of_doc: bool, at: int, b: int, step: int) -> str | None:
        """What b words, the last of them taken at the place `at`, make together."""
        lo = at - b + 1 if step > 0 else at
        if lo < 0 or lo + b > (len(words) if of_doc else len(item)):
            return None
        return "".join(words[lo : lo + b] if of_doc else spelled[lo : lo + b])

    def enough(left: list[Way], right: list[Way], own: float) -> bool:
        if left[-1][0] + SEED + right[-1][0] < RUN:
            return False
        longest = SEED + right[-1][0]
        for n1, e1, h1, m1 in left:
            if n1 + longest < RUN or PART * e1 >= n1 + longest:
                continue
            met = h1 if h1 > own else own
            for n2, e2, h2, m2 in right:
                n = n1 + SEED + n2
                if n >= RUN and PART * (e1 + e2) < n:
                    missed = m1 if m1 > m2 else m2
                    if met >= missed or h2 >= missed:
                        return True
        return False

    def ways(places, found) -> list[Way]:
        out, n, e, hit, miss = [(0, 0, LEAST, LEAST)], 0, 0, LEAST, LEAST
        for k in places:
            n += 1
            if found(k):
                hit = max(hit, weight[k])
                out.append((n, e, hit, miss))
            else:
                e, miss = e + 1, max(miss, weight[k])
                if e * PART - n >= RUN:
                    break
        return out

    @cache
    def possible(i: int) -> bool:
        """Whether some alignment around words i to i + SEED can do: what the document has nowhere is an error in each."""
        return enough(ways(range(i - 1, -1, -1), there.__getitem__), ways(range(i + SEED, len(item)), there.__getitem__), max(weight[i : i + SEED]))

    seen: set[tuple[int, int]] = set()
    apart = []
    for d, i in seeds:
        fresh = (d - 1, i - 1) not in seen
        seen.add((d, i))
        if fresh and possible(i):
            own = max(weight[i : i + SEED])
            apart.append((d, i, own))
            if enough(_extend(doc, d - 1, item, i - 1, joined, weight, -1), _extend(doc, d + SEED, item, i + SEED, joined, weight, 1), own):
                return True
    if not apart:
        return False
    parted = [x in around.joined for x in spelled]
    apieces = parted.copy()
    for k in together:
        apieces[k] = True
    how = (whole, weight, parted, words, runs)

    def banded(d: int, i: int, own: float) -> bool:
        """Whether an alignment in the band will do; each side is only worked out while the words that stand in the band allow it."""

        def within(k: int) -> bool:
            if apieces[k]:
                return True
            lo = d + k - i - BAND
            return item[k] in doc[max(lo, 0) : max(lo + 2 * BAND + 1, 0)]

        right = ways(range(i + SEED, len(item)), within)
        if not enough(ways(range(i - 1, -1, -1), within), right, own):
            return False
        left = _aligned(doc, d - 1, item, i - 1, *how, -1)
        return enough(left, right, own) and enough(left, _aligned(doc, d + SEED, item, i + SEED, *how, 1), own)

    return any(banded(*seed) for seed in apart)


_BUILT: dict[str, ItemIndex] = {}


def _index_of(name: str, items) -> ItemIndex:
    """The index of the broadcast items; a worker makes it once and holds one at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = ItemIndex(items.value)
    return _BUILT[name]


def leaks(documents: DataFrame, items: DataFrame, slice_items: int = 50_000) -> DataFrame:
    """item_id, doc_id: the documents that hold a part of an item. documents: doc_id, text; items: item_id, text."""
    rows = items.select("item_id", "text").where("text is not null and item_id is not null").orderBy("item_id")
    context = documents.sparkSession.sparkContext
    texts = documents.select("doc_id", "text").where("text is not null and doc_id is not null")

    def against(part: list[tuple[int, str]]) -> DataFrame:
        index, name = context.broadcast(part), uuid.uuid4().hex

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = _index_of(name, index)
            for pdf in frames:
                out, ids, texts, held = [], [], [], 0
                for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                    texts.append(words_of(t))
                    ids.append(d)
                    held += len(texts[-1])
                    if held >= WORDS_AT_ONCE:
                        out += [(i, d) for d, found in zip(ids, own.leaked(texts), strict=True) for i in found]
                        ids, texts, held = [], [], 0
                out += [(i, d) for d, found in zip(ids, own.leaked(texts), strict=True) for i in found]
                yield pd.DataFrame(out, columns=["item_id", "doc_id"], dtype="int64")

        return texts.mapInPandas(scan, "item_id bigint, doc_id bigint")

    # one slice at a time is in the driver; it goes out before the next comes in
    found: DataFrame | None = None
    part: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        if len(part) == slice_items:
            found = against(part) if found is None else found.unionByName(against(part))
            part = []
        part.append((r.item_id, r.text))
    last = against(part)
    return (last if found is None else found.unionByName(last)).distinct()


def leak_report(found: DataFrame) -> DataFrame:
    """item_id, n_documents: how many documents hold a part of each leaked item."""
    from pyspark.sql import functions as F

    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))
