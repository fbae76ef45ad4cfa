"""Canonical spellings of document and node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_ENDING = r"\.(json|pdf|txt|xml|html?|docx?|md)$"


def canonical_doc(c: Column) -> Column:
    """`uu-12-2019` for `UU_12_2019.json`, ` uu 12 2019 ` and the like; null for a null or blank id."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), FILE_ENDING, "")
    s = F.regexp_replace(F.trim(s), r"[\s_\-]+", "-")
    return F.nullif(F.regexp_replace(s, r"^-+|-+$", ""), F.lit(""))


def canonical_node(c: Column) -> Column:
    """`pasal_3_ayat_2_huruf_a` for `uu-12-2019/Pasal-3-Ayat-2-Huruf-A` and the like; null for a null or blank id."""
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    s = F.regexp_replace(s, r"^.*/", "")
    return F.nullif(F.regexp_replace(F.trim(s), r"[\s\-]+", "_"), F.lit(""))


def gold_doc(single: Column, several: Column) -> Column:
    """The document of a ground-truth record: the single id, or if that is null or blank the first of the list."""
    return F.coalesce(canonical_doc(single), canonical_doc(F.try_element_at(several, F.lit(1))))


def gold_docs(single: Column, several: Column) -> Column:
    """All documents of a ground-truth record, each once, none null."""
    every = F.concat(F.array(single), F.coalesce(several, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, canonical_doc), lambda x: x.isNotNull()))
