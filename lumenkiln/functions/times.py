"""Capture times: parsing, offsets, zones, consistency.  All values are TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def plus(ts: Column, *, days: Column | int = 0, hours: Column | int = 0, mins: Column | int = 0, secs: Column | float = 0) -> Column:
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ts + F.make_dt_interval(wrap(days).cast("int"), wrap(hours).cast("int"), wrap(mins).cast("int"), wrap(secs))


def exif_datetime(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss")).cast(NTZ)


def parse_offset(text: Column) -> Column:
    """Minutes of ``±HH:MM`` or ``±HHMM``; null beyond 14 hours."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"^([+-])(\d{2}):?(\d{2})$", i)
    hours, minutes = part(2).try_cast("int"), part(3).try_cast("int")
    valid = (hours <= 14) & (minutes <= 59) & ~((hours == 14) & (minutes != 0))
    return F.when(valid, F.when(part(1) == "-", -1).otherwise(1) * (hours * 60 + minutes))


def offset_label(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.when(minutes.isNotNull(), F.format_string("UTC%s%02d:%02d", F.when(minutes >= 0, "+").otherwise("-"), F.floor(size / 60).cast("int"), (size % 60).cast("int")))


def local_from_utc(zone: Column | str, utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, utc)


def utc_from_local(zone: Column | str, local: Column) -> Column:
    return F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)


def offset_minutes(local: Column, utc: Column) -> Column:
    return F.timestamp_diff("MINUTE", utc, local)


def seconds_off(local: Column, offset: Column, utc: Column) -> Column:
    """Truncated seconds between the utc that local and offset imply and the utc given."""
    return F.timestamp_diff("SECOND", plus(local, mins=-offset), utc)


def consistent(local: Column, offset: Column, utc: Column) -> Column:
    """Within a second, fractions counted; rows that lack a value pass."""
    micros = F.timestamp_diff("MICROSECOND", plus(local, mins=-offset), utc)
    return F.coalesce(F.abs(micros) <= 1_000_000, F.lit(True))


def as_search_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def first_of_next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)


def retry_delay_seconds(attempt: Column, base: int = 300, most: int = 3600) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2), attempt - 1)).cast("long")


def capture_time(exif: Column, existing: Column, modified: Column) -> Column:
    return F.coalesce(exif, existing, modified)


def capture_source(exif: Column, existing: Column, modified: Column) -> Column:
    return F.when(exif.isNotNull(), "Exif").when(existing.isNotNull(), "Existing").when(modified.isNotNull(), "FileMtime")


def needs_zone(zone: Column, offset: Column, lat: Column, lon: Column) -> Column:
    return (zone.isNull() | offset.isNull()) & lat.isNotNull() & lon.isNotNull()
