"""Instants written as ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch of an ISO-8601 instant in any common spelling; NULL if it can't be read.

    Read are: `T`, `t` or a space between date and time, `Z`, `z` or an offset with or without colon, fractions
    after a dot or comma, missing seconds, and the basic format without separators. Text without a zone is UTC.
    """
    plain = F.regexp_replace(F.upper(F.trim(text)), ",", ".")
    spread = F.regexp_replace(plain, r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?", "$1-$2-$3T$4:$5:$6")
    spread = F.regexp_replace(F.regexp_replace(spread, r":(?=$|[Z+\-.])", ":00"), r"([+\-]\d{2})(\d{2})?$", "$1:$2")
    spread = F.regexp_replace(spread, r"([+\-]\d{2}):$", "$1:00")
    spread = F.regexp_replace(spread, r"^(.{10}[T ]\d{2}:\d{2})(?=$|[Z+\-])", "$1:00")
    other = F.coalesce(F.unix_micros(_in_utc(plain).try_cast("timestamp")), F.unix_micros(_in_utc(spread).try_cast("timestamp")))
    usual = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")  # most are: no need to look for the zone
    return F.when(usual, F.unix_micros(text.try_cast("timestamp"))).otherwise(other)


def _in_utc(text: Column) -> Column:
    """The text with `Z` where it has no zone, so that the session's zone plays no part."""
    timed = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    return F.regexp_replace(timed, r"([T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d*)?)?)$", "$1Z")


def iso_text(micros: Column) -> Column:
    """Microseconds since the epoch as `2025-01-31T12:00:00Z`, whatever the session's zone."""
    second = F.floor(micros / F.lit(1_000_000))
    day = F.floor(second / F.lit(86_400)).cast("int")
    of_day = (second - day.cast("long") * 86_400).cast("int")
    two = F.array(*[F.lit(f"{i:02d}") for i in range(60)])
    hour, minute = F.floor(of_day / F.lit(3600)).cast("int"), F.floor(of_day % 3600 / F.lit(60)).cast("int")
    part = lambda n: F.element_at(two, n + 1)
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), part(hour), F.lit(":"), part(minute), F.lit(":"), part(of_day % 60), F.lit("Z"))
