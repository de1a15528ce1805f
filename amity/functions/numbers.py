"""Rounding of doubles to a number of decimal places, as column expressions.

Both work on the shortest decimal text of the double (1.005 is "1.005", not
1.00499999...), which is how Spark turns a double into a decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# wide enough for 20 integer digits and 18 decimals
_DEC = "decimal(38,18)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, bits: int = 2) -> Column:
    """HALF_UP rounding: 1.005 -> 1.01, 2.675 -> 2.68, -1.005 -> -1.01.
    Spark's ``round`` on a double already rounds its decimal text HALF_UP."""
    return F.round(_c(c).cast("double"), bits)


def truncate_decimal(c, bits: int = 2) -> Column:
    """Truncation toward zero: 1.009 -> 1.0, -1.009 -> -1.0, 0.29 -> 0.29.
    Doubles from 1e16 have no decimals to cut (NaN and infinities neither) and
    are returned as they are; they would not all fit the decimal type."""
    x = _c(c).cast("double")
    small = F.abs(x) < 1e16
    d = F.when(small, x).cast(_DEC)
    return F.when(~small, x).otherwise(F.when(d >= 0, F.floor(d, bits)).otherwise(F.ceil(d, bits)).cast("double"))
