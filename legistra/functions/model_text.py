"""Reading what a model wrote: fences, JSON inside prose, and the two halves of a cleaned text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def without_fence(text: Column) -> Column:
    """A text without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1"))


def first_array(text: str | None) -> str | None:
    """The first JSON array in a text that can be read, by matching brackets outside of strings; None if there is none."""
    start = 0
    while text and (start := text.find("[", start)) >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    try:
                        json.loads(text[start : i + 1])
                        return text[start : i + 1]
                    except ValueError:
                        break
        start += 1
    return None


@F.pandas_udf(StringType())
def json_array_in(texts: pd.Series) -> pd.Series:
    """first_array of every text."""
    return texts.map(first_array)


def cleaned_half(text: Column, mark: str = "---CLEANED---") -> Column:
    """What follows the mark, or the whole text where there is none."""
    return F.trim(F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1)).otherwise(text))
