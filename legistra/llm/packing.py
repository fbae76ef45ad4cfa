"""Filling containers of fixed capacity with texts, so that neighbours are alike and little space is unused.

Every text gets its size in tokens of a public tokenizer and a point in a few dimensions: its hashed words, projected
by signs. The points' Hilbert keys put the texts on one line on which neighbours are alike. The line is sorted by
range over all tasks and cut into blocks of bounded size; in each block the texts, largest first, go to the
fullest container that still holds them. Containers that stay too empty are opened again and packed with those of
the neighbouring blocks, round by round, while that saves space.

A text larger than the capacity is split into full pieces and a rest; no other text is split. Null and empty texts, those
without a token, and those without an id go nowhere. Exact copies are packed like any other text. Targets that are null or not
positive are left out.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legistra.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text for byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DIMENSIONS, BITS = 3, 10
BLOCK = 4096  # pieces packed together


def encoder(path: str):
    """The tokenizer in a rank file."""
    with open(path, "rb") as f:
        return encoder_of(f.read(), os.path.basename(path))


def encoder_of(ranks: bytes, name: str):
    """The tokenizer of a rank file's contents."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def hilbert_key(point: list[int], bits: int = BITS) -> int:
    """The place of a point of whole numbers below 2^bits on the Hilbert curve through their cube."""
    x = list(point)
    n = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:  # undo the excess work of every level
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = 0, high
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    x = [v ^ t for v in x]
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


class Projector:
    """Texts as points: the mean of their words' hashed sign vectors, squeezed into the cube."""

    def __init__(self):
        self.known: dict[str, tuple[float, ...]] = {}

    def _word(self, w: str) -> tuple[float, ...]:
        if len(self.known) > 400_000:
            self.known.clear()
        h = xxhash.xxh64_intdigest(w)
        # every dimension adds up eight signs, which is near enough to a normal direction
        v = self.known[w] = tuple(float((h >> 8 * d & 255).bit_count() - 4) for d in range(DIMENSIONS))
        return v

    def key(self, text: str) -> int:
        ws = set(text.lower().split())
        if not ws:
            return 0
        known, word = self.known, self._word
        sums = [sum(c) for c in zip(*[known.get(w) or word(w) for w in ws], strict=True)]
        # the sum of n words spreads as the square root of n; the normal scale fills the cube evenly
        z = np.array(sums) / (2.0**0.5 * len(ws) ** 0.5)
        unit = 1 / (1 + np.exp(-1.7 * z))
        return hilbert_key([min((1 << BITS) - 1, int(u * (1 << BITS))) for u in unit])


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens, place: the size of each text, and its place on the curve.

    The tokenizer's file is read by the driver and sent to the workers, a few megabytes whatever the data.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    name = os.path.basename(tokenizer)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, projector = encoder_of(ranks.value, name).encode_ordinary, Projector()
        for pdf in frames:
            texts = pdf["text"].tolist()
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "tokens": [len(encode(t)) for t in texts], "place": [projector.key(t) for t in texts]}
            )

    rows = documents.select("doc_id", "text").where("text is not null and text <> '' and doc_id is not null")
    return rows.mapInPandas(scan, "doc_id bigint, tokens bigint, place bigint").where("tokens > 0")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """A container number for each size, all at most the capacity: largest first, each to the fullest that holds it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms: list[tuple[int, int]] = []  # (free space, container), sorted
    where, opened = [0] * len(sizes), 0
    for i in order:
        k = bisect.bisect_left(rooms, (sizes[i], -1))
        if k < len(rooms):
            free, c = rooms.pop(k)
        else:
            free, c, opened = capacity, opened, opened + 1
        where[i] = c
        if free > sizes[i]:
            bisect.insort(rooms, (free - sizes[i], c))
    return where


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's pieces with their container and how full that is."""
    pdf = pdf.sort_values(["place", "doc_id", "piece_no"], kind="stable")
    where = best_fit(pdf["tokens"].astype(int).tolist(), int(pdf["capacity"].iloc[0]))
    return pdf.assign(container=where, used=pdf["tokens"].groupby(where).transform("sum").astype("int64"))


def packed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, rounds: int = 3, full_enough: float = 0.98) -> DataFrame:
    """target_name, container_id, doc_id, piece_no, tokens: every piece of every text in one container of each target.

    piece_no is 0 for a text that isn't split, and counts from 1 for the pieces of one that is.
    """
    spark = documents.sparkSession
    goals = targets.where("target_name is not null and capacity_tokens > 0").select("target_name", "capacity_tokens").distinct().collect()
    texts = cut(sized(documents, tokenizer))
    # the targets are a fixed handful of settings
    each = [F.struct(F.lit(g.target_name).alias("target_name"), F.lit(g.capacity_tokens).cast("bigint").alias("capacity")) for g in goals]
    no_goal = F.array().cast("array<struct<target_name:string,capacity:bigint>>")
    every = texts.select("*", F.inline(F.array(*each) if each else no_goal))
    whole, rest = F.floor(F.col("tokens") / F.col("capacity")), F.col("tokens") % F.col("capacity")
    numbers = F.when(F.col("tokens") <= F.col("capacity"), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(1).cast("bigint"), whole + F.when(rest > 0, 1).otherwise(0))
    )
    piece = F.when(F.col("piece_no") == 0, F.col("tokens")).when(F.col("piece_no") <= whole, F.col("capacity")).otherwise(rest)
    pieces = every.withColumn("piece_no", F.explode(numbers)).select("target_name", "capacity", "place", "doc_id", "piece_no", piece.alias("tokens"))
    schema = "target_name string, capacity bigint, place bigint, doc_id bigint, piece_no bigint, tokens bigint, container bigint"
    # full pieces have a container to themselves
    done = [
        pieces.where("tokens = capacity").select(
            "target_name", F.concat_ws("-", F.lit("0"), F.hex("doc_id"), "piece_no").alias("container_id"), "doc_id", "piece_no", "tokens"
        )
    ]
    open_pieces = pieces.where("tokens < capacity")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for number in range(1, rounds + 1):
        ranged = open_pieces.repartitionByRange(n, "target_name", "place", "doc_id", "piece_no").sortWithinPartitions("target_name", "place", "doc_id", "piece_no")
        # blocks along the curve; a task's rows are numbered in their order
        numbered = ranged.mapInPandas(_numbered, "target_name string, capacity bigint, place bigint, doc_id bigint, piece_no bigint, tokens bigint, __block string")
        last = number == rounds
        put = cut(numbered.groupBy("__block").applyInPandas(_pack_block, schema + ", used bigint, __block string"))
        judged = put.withColumn("full", F.lit(last) | (F.col("used") >= full_enough * F.col("capacity")))
        done.append(
            judged.where("full").select(
                "target_name", F.concat_ws("-", F.lit(str(number)), "__block", F.hex("container")).alias("container_id"), "doc_id", "piece_no", "tokens"
            )
        )
        open_pieces = judged.where("not full").select("target_name", "capacity", "place", "doc_id", "piece_no", "tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, at, target, block = TaskContext.get().partitionId(), 0, None, 0
    for pdf in frames:
        names = []
        for t in pdf["target_name"]:
            if t != target:
                target, at, block = t, 0, block + 1
            elif at >= BLOCK:
                at, block = 0, block + 1
            at += 1
            names.append(f"{part:x}.{block:x}")
        yield pdf.assign(__block=names)


def fill_report(containers: DataFrame, targets: DataFrame) -> DataFrame:
    """target_name, capacity_tokens, n_containers, n_tokens, unused_share."""
    by = containers.groupBy("target_name").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    goals = targets.select("target_name", "capacity_tokens").distinct()
    room = F.col("n_containers") * F.col("capacity_tokens")
    return by.join(goals, "target_name").select("target_name", "capacity_tokens", "n_containers", "n_tokens", F.round(1 - F.col("n_tokens") / room, 5).alias("unused_share"))
