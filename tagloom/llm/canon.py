"""Canonical forms shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alnum(c: str | Column) -> Column:
    """Letters and digits (Unicode L and N) after lower-casing; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def line_set(c: str) -> Column:
    """The letters and digits of each line, empty lines dropped, in an order of their own (one string)."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]")
    return F.array_join(F.array_sort(F.filter(F.transform(lines, alnum), lambda x: x != "")), "\n")
