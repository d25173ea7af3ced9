"""Scalar functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.dialects import OFFSET, java_layout

DAY, HOUR, MINUTE = 86400, 3600, 60


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Round half away from zero."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round_up(x: Column, digits: int = 0) -> Column:
    """One step away from zero beyond the truncated value, for exact values too."""
    scale = 10.0**digits
    return (round_down(x * scale) + F.when(x >= 0, 1.0).otherwise(-1.0)) / scale


def round_down(x: Column, digits: int = 0) -> Column:
    """Truncate toward zero."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def next_divisible(i: Column, n: Column) -> Column:
    """The least multiple of n that is not below i; i itself if n is 0."""
    return F.when(n == 0, i).otherwise(F.ceil(i / n) * n).cast("long")


def to_base36(i: Column) -> Column:
    return F.lower(F.conv(i.cast("string"), 10, 36))


def from_base36(s: Column) -> Column:
    return F.conv(s, 36, 10).cast("long")


def to_int_or_zero(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))


def is_int(s: Column) -> Column:
    """Digits without a leading zero, or 0."""
    return s.rlike(r"^(0|[1-9][0-9]*)$")


def is_real_number(s: Column) -> Column:
    """Digits with at most one dot between them."""
    return s.rlike(r"^\p{Nd}+(\.\p{Nd}+)?$")


def is_numeric(s: Column) -> Column:
    return s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def add_days(epoch: Column, days: int) -> Column:
    return epoch + days * DAY


def days_before(days: int, now: Column) -> Column:
    """The epoch of `days` days before now."""
    return now - days * DAY


def epoch_to_string(epoch: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(epoch, pattern)


def time_bucket(epoch: Column, unit: int) -> Column:
    return (F.floor(epoch / unit) * unit).cast("long")


def unit_seconds(frequency: str) -> int:
    """Seconds of 'day', 'hour' or 'minute'."""
    return {"day": DAY, "hour": HOUR, "minute": MINUTE}[frequency]


def datetime_format(unit: int) -> str:
    """Java's pattern that shows times to this unit."""
    return "yyyy-MM-dd" if unit >= DAY else "yyyy-MM-dd HH" if unit >= HOUR else "yyyy-MM-dd HH:mm" if unit >= MINUTE else "yyyy-MM-dd HH:mm:ss"


def parse_date(text: Column, layout: str, now: Column | None = None) -> Column:
    """The epoch seconds of a text by a layout, or null.

    Missing years, months and days are those of `now` (a timestamp; the current time). Without a year,
    a time that would be later than now by month is in the year before. An offset is ignored.
    """
    now = F.current_timestamp() if now is None else now
    pattern, names, offset = java_layout(re.sub(r"(02|_2|2)(?:st|nd|rd|th)", r"\1", layout))
    text = F.regexp_replace(text, r"(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    if offset:
        text = F.regexp_replace(text, OFFSET, "")
    for name, letters, value in (("day", "dd", F.date_format(now, "dd")), ("month", "MM", F.date_format(now, "MM")), ("year", "yyyy", F.date_format(now, "yyyy"))):
        if name not in names:
            text, pattern = F.concat(value, F.lit(" "), text), f"{letters} {pattern}"
    parsed = F.try_to_timestamp(text, F.lit(pattern))
    if "year" not in names and "month" in names:
        parsed = F.when(F.month(parsed) > F.month(now), F.add_months(parsed, -12).cast("timestamp") + (parsed - F.date_trunc("day", parsed))).otherwise(parsed)
    return F.unix_timestamp(parsed)


def timestamp_utc(text: Column, layout: str) -> Column:
    """The epoch seconds of a text by a layout that has all fields, or null."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(java_layout(layout)[0])))


def strings(values: Column) -> Column:
    """An array of numbers as strings."""
    return F.transform(values, lambda x: x.cast("string"))


def sorted_places(values: Column) -> Column:
    """Positions (from 0) of an array's values in ascending order; ties by position."""
    return F.transform(F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i")))), lambda s: s["i"])
