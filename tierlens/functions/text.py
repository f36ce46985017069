"""Small text column helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(c: Column) -> Column:
    """Whitespace trim on both ends (newlines and tabs too, not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def md5_len(c: Column, name: str) -> list[Column]:
    """Comparable stand-ins for a text column: its md5 and its length."""
    return [F.md5(c).alias(f"{name}_md5"), F.length(c).cast("bigint").alias(f"{name}_len")]
