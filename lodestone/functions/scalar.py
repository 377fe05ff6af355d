"""Scalar functions as Column -> Column; they never truncate when padding, count positions from 0, and skip nulls in concat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]
#: Unit names and Spark's.
UNITS = {"days": "DAY", "months": "MONTH", "years": "YEAR", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND"}


def date_add(unit: str, n: int) -> Fn:
    """An unknown unit changes nothing; the end of a month is clamped."""
    return lambda c: F.timestamp_add(UNITS[unit], F.lit(n), c).cast("timestamp_ntz") if unit in UNITS else c


def date_subtract(unit: str, n: int) -> Fn:
    return date_add(unit, -n)


def extract_part(part: str) -> Fn:
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    if part not in parts:
        raise ValueError(f"unknown part {part!r}")
    return parts[part]


def format_date(pattern: str) -> Fn:
    return lambda c: F.date_format(c, pattern)


def date_difference(start: Column, end: Column, unit: str) -> Column:
    """Complete units from start to end, truncated toward zero."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return F.timestamp_diff(UNITS[unit], start, end)


def concat(*parts: object) -> Fn:
    """Joins the parts; the column's own value is not among them."""
    return lambda _: F.concat_ws("", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts if p is not None))


def upper_case() -> Fn:
    return F.upper


def lower_case() -> Fn:
    return F.lower


def trim() -> Fn:
    """Strips every character up to U+0020 at both ends."""
    return lambda c: F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def substring(start: int, length: int) -> Fn:
    """From position ``start``, counted from 0; a start behind the end is an error, a negative one counts as 0 after the end is set."""

    def run(c: Column) -> Column:
        end = F.least(F.length(c), F.lit(start + length))
        begin = max(start, 0)
        got = F.substring(c, F.lit(begin + 1), F.greatest(end - begin, F.lit(0)))
        return F.when(F.length(c) < begin, F.raise_error(F.lit("substring starts behind the end")).cast("string")).otherwise(got)

    return run


def left(n: int) -> Fn:
    if n < 0:
        raise ValueError("a length is negative")
    return lambda c: F.left(c, F.lit(n))


def right(n: int) -> Fn:
    if n < 0:
        raise ValueError("a length is negative")
    return lambda c: F.when(c.isNotNull(), F.right(c, F.lit(n)))


def replace(old: str, new: str) -> Fn:
    if not old:
        raise ValueError("an empty text cannot be replaced")
    return lambda c: F.replace(c, F.lit(old), F.lit(new))


def regexp_replace(pattern: str, new: str) -> Fn:
    return lambda c: F.regexp_replace(c, pattern, new)


def left_pad(width: int, pad: str | None = " ") -> Fn:
    return lambda c: F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, pad or " "))


def right_pad(width: int, pad: str | None = " ") -> Fn:
    return lambda c: F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, pad or " "))


def reverse() -> Fn:
    return F.reverse
