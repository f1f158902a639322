"""ISO local times kept as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date; days beyond a month's end roll over."""
    return F.datediff(F.make_date(y, m, F.lit(1)), F.lit("1970-01-01").cast("date")) + d - 1


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970, any zone ignored, days of short months rolling over; null if it isn't a time."""
    at = lambda a, n: F.substring(text, a, n).try_cast("int")
    shape = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])-\d\d")
    day = F.when(shape, civil_days(at(1, 4), at(6, 2), at(9, 2)))
    return day.cast("long") * 86400 + F.coalesce(at(12, 2), F.lit(0)) * 3600 + F.coalesce(at(15, 2), F.lit(0)) * 60 + F.coalesce(at(18, 2), F.lit(0))


def from_seconds(secs: Column) -> Column:
    return F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd'T'HH:mm:ss")


def shift_iso(text: Column, seconds: int) -> Column:
    """Moved by ``seconds``, with whatever follows the seconds kept."""
    return F.concat(from_seconds(iso_seconds(text) + seconds), F.substring(text, 20, 64))


def normalize_iso(text: Column) -> Column:
    """The canonical form; null for dates that a calendar doesn't have."""
    clean = F.regexp_replace(F.trim(text), r"^(\d{4})[:/-](\d\d)[:/-](\d\d)[ T]", "$1-$2-$3T")
    secs = iso_seconds(clean)
    same = F.substring(from_seconds(secs), 1, 10) == F.substring(clean, 1, 10)
    return F.when(same, from_seconds(secs))


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of ``Z``, ``+hh``, ``+hhmm`` or ``+hh:mm``; null for anything else and beyond 18 hours."""
    clean = F.rtrim(F.trim(text), F.lit("\0"))
    part = lambda n: F.regexp_extract(clean, r"^[+-](\d{1,2})(?::?(\d\d))?$", n)
    hours, minutes = part(1).try_cast("int"), F.coalesce(part(2).try_cast("int"), F.lit(0))
    east = F.when((hours <= 18) & (minutes <= 59), hours * 60 + minutes)
    return F.when(clean == "Z", 0).otherwise(F.when(clean.startswith("-"), -east).otherwise(east))


def utc_seconds(text: Column, offset: Column) -> Column:
    """Seconds since 1970 of a camera's time (``yyyy:mm:dd hh:mm:ss`` or ISO); where the offset is unknown, of local time."""
    return iso_seconds(normalize_iso(text)) - 60 * F.coalesce(offset_minutes(offset), F.lit(0))


def weekday(text: Column) -> Column:
    return F.date_format(F.timestamp_seconds(iso_seconds(text)), "EEEE")


def display_time(text: Column) -> Column:
    return F.date_format(F.timestamp_seconds(iso_seconds(text)), "MMMM d, y 'at' h:mm:ss a")


def group_label(text: Column, by: str) -> Column:
    """A header's text: day, month or year of a date."""
    pattern = {"day": "EEEE, MMMM d, y", "month": "MMMM y", "year": "y"}[by]
    return F.coalesce(F.date_format(F.timestamp_seconds(iso_seconds(text)), pattern), F.lit("Unknown Date"))
