"""Calendar helpers as column expressions.

"Now" is never read: each helper takes the reference time as a column
(``as_of``), so results are reproducible and work per row.  Patterns are
Spark datetime patterns (``yyyy-MM-dd``); the session time zone (UTC in
tests) applies to epoch conversions.  Time of day is kept wherever the
calendar arithmetic keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FMT = "yyyy-MM-dd"

# fixed patterns: a year-month-day or year-month text with / or - separators
YMD_PATTERN = r"\d{4}(/|-)\d{1,2}(/|-)\d{1,2}"
YM_PATTERN = r"\d{4}(/|-)\d{1,2}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_format_col(c, fmt: str = DEFAULT_FMT) -> Column:
    return F.date_format(_c(c), fmt)


def shift(as_of, amount, unit: str) -> Column:
    """``as_of`` moved by ``amount`` calendar units (YEAR, MONTH, WEEK, DAY,
    HOUR, MINUTE, SECOND); month ends clamp (03-31 minus a month is 02-29)."""
    qty = amount if isinstance(amount, Column) else F.lit(int(amount))
    return F.timestamp_add(unit, qty, _c(as_of))


def time_ago(as_of, m: int, unit: str = "DAY", fmt: str = DEFAULT_FMT) -> Column:
    return F.date_format(shift(as_of, -m, unit), fmt)


def days_ago(as_of, m: int = 0, fmt: str = DEFAULT_FMT) -> Column:
    return time_ago(as_of, m, "DAY", fmt)


def months_ago(as_of, m: int = 0, fmt: str = DEFAULT_FMT) -> Column:
    return time_ago(as_of, m, "MONTH", fmt)


def years_ago(as_of, m: int = 0, fmt: str = DEFAULT_FMT) -> Column:
    return time_ago(as_of, m, "YEAR", fmt)


def month_end_ago(as_of, m: int = 0, fmt: str = DEFAULT_FMT) -> Column:
    """Last day of the month ``m`` months back, time of day kept."""
    x = shift(as_of, -m, "MONTH")
    return F.date_format(shift(x, F.datediff(F.last_day(x), F.to_date(x)), "DAY"), fmt)


def week_bounds_ago(as_of, m: int = 0, fmt: str = DEFAULT_FMT) -> Column:
    """Monday and Sunday of the week ``m`` weeks back (a Sunday ends its
    week): struct(week_begin, week_end)."""
    d = _c(as_of)
    since_monday = (F.dayofweek(d) + F.lit(5)) % F.lit(7)
    begin = shift(d, -(since_monday + F.lit(7 * m)), "DAY")
    end = shift(d, F.lit(6 - 7 * m) - since_monday, "DAY")
    return F.struct(F.date_format(begin, fmt).alias("week_begin"),
                    F.date_format(end, fmt).alias("week_end"))


def epoch_ms_format(ms, fmt: str) -> Column:
    """Epoch milliseconds as text in the session time zone."""
    return F.date_format(F.timestamp_millis(_c(ms)), fmt)


def extract_ymd(s) -> Column:
    """First year-month-day text in ``s``, '' when there is none."""
    return F.regexp_extract(_c(s), YMD_PATTERN, 0)


def extract_ym(s) -> Column:
    """First year-month text in ``s``, '' when there is none."""
    return F.regexp_extract(_c(s), YM_PATTERN, 0)


def date_parts(as_of) -> list[Column]:
    d = _c(as_of)
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day")]


def parse_date(s, fmt: str = "yyyy-M-d") -> Column:
    """Text to timestamp_ntz; unparseable text (trailing characters, month 13)
    gives null instead of the lenient roll-over of a Java date parser."""
    return F.try_to_timestamp(_c(s), F.lit(fmt)).cast("timestamp_ntz")


def reformat_date(s, old_fmt: str, new_fmt: str) -> Column:
    return F.date_format(F.try_to_timestamp(_c(s), F.lit(old_fmt)), new_fmt)


def days_in_month(as_of) -> Column:
    return F.dayofmonth(F.last_day(_c(as_of)))


def quarter_start(as_of, fmt: str = DEFAULT_FMT) -> Column:
    """First day of the quarter, time of day kept."""
    d = _c(as_of)
    back = F.datediff(F.to_date(d), F.to_date(F.date_trunc("quarter", d)))
    return F.date_format(shift(d, -back, "DAY"), fmt)
