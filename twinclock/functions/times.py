"""Time columns: micros of a timestamp with or without zone, ISO texts with an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a timestamp without zone counts as UTC, whatever zone the session has."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def offset_seconds(offset: Column) -> Column:
    """Seconds of +HH:MM or -HH:MM; Z is zero."""
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    return F.when(offset == "Z", 0).otherwise(sign * (F.substring(offset, 2, 2).cast("long") * 3600 + F.substring(offset, 5, 2).cast("long") * 60))


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO text with any number of digits of a second and an offset."""
    part = lambda k: F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)$", k)
    days = F.datediff(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + part(2).cast("long") * 3600 + part(3).cast("long") * 60 + part(4).cast("long") - offset_seconds(part(6))
    return F.when(part(1) != "", seconds * 1000000 + F.rpad(F.substring(part(5), 1, 6), 6, "0").cast("long"))


def iso_text(us: Column, offset: Column) -> Column:
    """The ISO text, with six digits of a second, of microseconds since 1970 at an offset."""
    local = us + offset_seconds(offset) * 1000000
    days, rest = F.floor(local / 86400000000), F.pmod(local, F.lit(86400000000))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    whole = F.floor(rest / 1000000)
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, rest % 1000000)
    return F.concat(date, F.lit("T"), clock, offset)
