"""Trimming and tuple-building over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Java String.trim removes every char <= U+0020 from both ends (fixed set)
JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c) -> Column:
    """Strip control characters and spaces from both ends; null stays null.
    Spark's plain ``trim`` strips spaces only."""
    return F.trim(_c(c), F.lit(JAVA_TRIM_CHARS))


def trim_array(c) -> Column:
    """Trim every element of an array of strings."""
    return F.transform(_c(c), java_trim)


def trim_all_columns(df: DataFrame) -> DataFrame:
    """Every column as trimmed text, names kept."""
    return df.select(*[java_trim(F.col(n).cast("string")).alias(n) for n in df.columns])


def array_to_struct(c, size: int) -> Column:
    """First ``size`` elements of an array as struct fields _1 .. _size
    (missing elements are null)."""
    arr = _c(c)
    return F.struct(*[F.get(arr, i).alias(f"_{i + 1}") for i in range(size)])
