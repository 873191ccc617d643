"""Scalar expressions shared by the jobs. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_TIME = "yyyy-MM-dd HH:mm:ss"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds_of(duration: str) -> int:
    """Length in seconds of a duration such as ``'10 seconds'`` or ``'12 hours'``."""
    match = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", duration)
    if not match:
        raise ValueError(f"unsupported duration: {duration!r}")
    return int(match.group(1)) * _UNIT_SECONDS[match.group(2)]


def epoch_ms_to_second_ts(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp cut to whole seconds."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp that keeps the milliseconds."""
    return F.timestamp_millis(ms)


def processing_ms() -> Column:
    """Wall-clock time of the run (of the micro-batch on a stream) in whole seconds, as milliseconds."""
    return F.unix_timestamp() * 1000


def text_to_ts(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp, null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(TEXT_TIME))


def ts_to_text(ts: Column) -> Column:
    return F.date_format(ts, TEXT_TIME)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_number(ts: Column) -> Column:
    """Day as the integer ``yyyyMMdd``."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def age_years(birthday: Column, as_of: Column) -> Column:
    """Whole years of 365 days between a birthday and a moment."""
    year_ms = 1000 * 60 * 60 * 24 * 365
    elapsed = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(birthday.cast("timestamp"))
    return F.floor(elapsed / F.lit(year_ms)).cast("bigint")


def half_up_div(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded half up, as a whole number of 10**-digits units.

    Non-negative whole inputs; 0 when the divisor is 0 or null. Integer
    arithmetic keeps the rounding exact.
    """
    doubled = num * F.lit(2 * 10**digits) + den
    quotient = F.call_function("div", doubled, den * 2)
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(quotient)


def scaled(units: Column, digits: int) -> Column:
    """Whole 10**-digits units as a decimal."""
    return (units.cast("decimal(20,0)") / F.lit(10**digits).cast("decimal(10,0)")).cast(
        f"decimal(20,{digits})"
    )


def short_name_or(name: Column, default: str) -> Column:
    """Names of at most one character are replaced by a default."""
    return F.when(F.length(name) > 1, name).otherwise(F.lit(default))


def padded_hour(hour: Column) -> Column:
    return F.lpad(hour.cast("string"), 2, "0")


def lower_camel(name: str) -> str:
    """``UPPER_SNAKE`` column name to ``lowerCamel``."""
    first, *rest = name.lower().split("_")
    return first + "".join(part.capitalize() for part in rest)
