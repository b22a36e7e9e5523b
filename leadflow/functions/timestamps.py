"""Date and time columns. Zone-free values (TIMESTAMP_NTZ) are UTC wall clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_DATE = "0000-00-00"
EPOCH = "1970-01-01 00:00:00"
CDC_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Texts that Spark's own cast reads: a four-digit year, then nothing or a non-digit.
# Longer digit runs would be taken for a far-away year; the cast knows no halves of the day.
ISO = r"(?i)^\s*\d{4}(?!\d)(?!/)(?!.*[AP]M$)"

# A day's name in front, which Spark's patterns cannot read, is dropped.
DAY_NAME = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"

# Other layouts, month first: what the text looks like, and how to read it. At most
# one is tried per value. Extend by argument.
_DATES = (
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{4}/\d+/\d+", "yyyy/M/d"),
    (r"\d{1,2}/\d+/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}-\d+-\d{4}", "M-d-yyyy"),
    (r"\d{1,2} [a-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [a-z]{4,} \d{4}", "d MMMM yyyy"),
    (r"[a-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"[a-z]{4,} \d{1,2}, \d{4}", "MMMM d, yyyy"),
)
_CLOCK = r"\d{1,2}:\d{1,2}(?::\d{1,2})?"
LAYOUTS = (
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"),
    (rf"(?i)^\d{{4}}-\d+-\d+ {_CLOCK} [ap]m$", "yyyy-M-d h:m[:s] a"),
    *[(f"(?i)^{day}(?: {_CLOCK})?$", f"{pattern}[ H:m[:s]]") for day, pattern in _DATES],
    *[(f"(?i)^{day} {_CLOCK} [ap]m$", f"{pattern} h:m[:s] a") for day, pattern in _DATES],
)


def ntz(value: str | dt.datetime | Column) -> Column:
    """A zone-free timestamp from a literal text, a datetime or a column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def utc_now(now: str | dt.datetime | Column | None = None) -> Column:
    """The query's time as UTC wall clock, or a given time."""
    if now is not None:
        return ntz(now)
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def pinned(now: str | dt.datetime | None) -> str | dt.datetime:
    """A given time, or this moment: one time for all queries of a job."""
    return dt.datetime.now(dt.UTC).replace(tzinfo=None) if now is None else now


def stamp(df: DataFrame, field: str = "ingestion_timestamp", now=None) -> DataFrame:
    return df.withColumn(field, utc_now(now))


def utc_clock(value: Column) -> Column:
    """A TIMESTAMP as zone-free UTC wall clock, whatever the session's zone."""
    return F.convert_timezone(None, F.lit("UTC"), value.cast("timestamp_ntz"))


def plain_text(value: Column, kind: T.DataType) -> Column:
    """Default text of a date or time: no fraction, or one of six digits."""
    if isinstance(kind, T.DateType):
        return value.cast("string")
    zoned = isinstance(kind, T.TimestampType)
    text = (utc_clock(value) if zoned else value).cast("string")
    text = F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(text, F.lit("+00:00")) if zoned else text


def pattern_text(value: Column, kind: T.DataType, pattern: str) -> Column:
    zoned = isinstance(kind, T.TimestampType)
    return F.date_format(utc_clock(value) if zoned else value, pattern)


def drop_zero_date(text: Column) -> Column:
    return F.when(~F.contains(text, F.lit(ZERO_DATE)), text)


def parse_datetime(text: Column, layouts=LAYOUTS) -> Column:
    """Text to TIMESTAMP_NTZ; null when no layout fits. An offset is dropped."""
    plain = F.regexp_replace(text, DAY_NAME, "")
    # One condition finds the layout's pattern, so that a text is parsed once.
    pattern = F.when(F.lit(False), F.lit(""))
    for shape, known in layouts:
        pattern = pattern.when(plain.rlike(shape), F.lit(known))
    value = F.try_to_timestamp(plain, pattern).cast("timestamp_ntz")
    return F.when(text.rlike(ISO), text.try_cast("timestamp_ntz")).otherwise(value)


def parse_date(text: Column, layouts=LAYOUTS) -> Column:
    return parse_datetime(text, layouts).cast("date")


def parse_timestamp(text: Column, layouts=LAYOUTS) -> Column:
    """Text to TIMESTAMP; an offset counts, without one the text is UTC."""
    has_offset = text.rlike(ISO) & text.rlike(r":\d.*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$")
    plain = F.concat(parse_datetime(text, layouts).cast("string"), F.lit("+00:00"))
    return F.when(has_offset, text.try_cast("timestamp")).otherwise(plain.cast("timestamp"))


def epoch_seconds(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp")) / F.lit(1e6)


def is_date(text: Column, layouts=LAYOUTS) -> Column:
    return F.coalesce(parse_datetime(text, layouts).isNotNull(), F.lit(False))


def hour_diff(later: Column, earlier: Column) -> Column:
    """Number of full-hour marks between two times, not of elapsed hours."""
    days = F.datediff(later.cast("date"), earlier.cast("date"))
    return days * 24 + F.hour(later) - F.hour(earlier)


def hours_before(now: Column, hours: int) -> Column:
    """The earliest time with ``hour_diff(now, time) <= hours``.

    Comparing a column with this bound gives a filter that reaches the files.
    """
    into_hour = F.make_dt_interval(
        mins=F.minute(now), secs=F.date_part(F.lit("SECOND"), now)
    )
    return now - into_hour - F.make_dt_interval(hours=F.lit(hours))


def next_checkpoint(last: Column) -> Column:
    return last + F.expr("interval '0.000001' second")


_NANOSECOND_TIME = (
    r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})\.(\d{1,6})\d{3} ([+-]\d{2}:?\d{2}) (UTC|GMT)$"
)


def parse_nanoseconds(text: Column) -> Column:
    """``2020-11-19 01:02:03.123456789 +0000 UTC`` to TIMESTAMP, three digits dropped."""
    fits = text.rlike(_NANOSECOND_TIME)
    short = F.regexp_replace(text, _NANOSECOND_TIME, "$1.$2 $3")
    return F.when(
        fits,
        F.coalesce(
            F.try_to_timestamp(short, F.lit("yyyy-M-d H:m:s.SSSSSS Z")),
            F.try_to_timestamp(short, F.lit("yyyy-M-d H:m:s.SSSSSS xxx")),
        ),
    )


def is_expired(text: Column, now: Column) -> Column:
    """Past, missing and unreadable expiry times all count as expired."""
    return F.coalesce(parse_nanoseconds(text) < now, F.lit(True))
