"""A retrieval agent replayed from a script of its actions, and what it hands in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS, READS, FAILURES = 30, 18, 3


def replay(steps: DataFrame, known: DataFrame, actions: int = ACTIONS, reads: int = READS) -> DataFrame:
    """query_id, outcome, n_actions, n_reads, submitted of each scripted run.

    steps: query_id, step, action (expand, read, submit; null where it couldn't be parsed), refs. known: query_id, ref, the refs
    that exist. A run ends with its first valid submit, with three unparsed steps, or when a budget is used up. Refs that
    don't exist are dropped; a submit without any left goes on. A run is one question's few steps.
    """
    refs = known.groupBy("query_id").agg(F.collect_set("ref").alias("__known"))
    joined = steps.join(refs, "query_id", "left").select("query_id", "step", "action", "refs", "__known")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n_reads, bad, outcome, out = 0, 0, 0, "open", []
        for r in pdf.sort_values("step").itertuples():
            if not isinstance(r.action, str) or r.action not in ("expand", "read", "submit"):
                bad += 1
                if bad >= FAILURES:
                    outcome = "unparsed"
                    break
                continue
            n += 1
            there = set(pdf["__known"].iloc[0]) if pdf["__known"].iloc[0] is not None else set()
            mine = [x for x in (r.refs if r.refs is not None else []) if x in there]
            if r.action == "submit" and mine:
                outcome, out = "submitted", mine
                break
            n_reads += r.action == "read"
            if n >= actions or n_reads >= reads:
                outcome = "budget"
                break
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "outcome": [outcome], "n_actions": [n], "n_reads": [n_reads], "submitted": [out]})

    return joined.groupBy("query_id").applyInPandas(one, "query_id bigint, outcome string, n_actions bigint, n_reads bigint, submitted array<string>")


def finalized(refs: Column, k: int) -> Column:
    """The first k of an array's non-empty entries, each once; nothing is filled up."""
    return F.slice(F.array_distinct(F.filter(refs, lambda x: x.isNotNull() & (x != ""))), 1, k)


def clipped(text: Column, place_from_end: Column, recent: int = 1800, older: int = 600) -> Column:
    """An entry of a scratchpad: the last two at full length, earlier ones shorter."""
    return F.when(place_from_end <= 2, F.substring(text, 1, recent)).otherwise(F.substring(text, 1, older))
