"""Dates as feeds write them, as Columns: ISO 8601 and RFC 822 to seconds since 1970 UTC, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semrank.constants import FUTURE_S

# Named zones in hours east of UTC.
ZONES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "BST": 1}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

ISO = r"^(\d{4})-(\d\d)-(\d\d)(?:[Tt ](\d\d):(\d\d)(?::(\d\d)(?:[.,]\d+)?)?)?\s*(\S*)$"
RFC = r"^(?:[\p{L}.]+[ ,\t]+)?(\d{1,2})[ ,\t]+(\p{L}{3})\p{L}*[ ,\t]+(\d{1,4})(?:[ ,\t]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:[ ,\t]+(\S+).*)?)?$"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(0))


def zone_seconds(zone: Column) -> Column:
    """Seconds east of UTC; null if unreadable."""
    named = F.element_at(F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v)]), F.upper(zone))
    form = r"^([+-])(\d\d):?(\d\d)?$"
    hours, minutes = _int(zone, form, 2), _int(zone, form, 3)
    sign = F.when(F.regexp_extract(zone, form, 1) == "-", -1).otherwise(1)
    offset = F.when(zone.rlike(form) & (hours <= 14) & (minutes < 60), sign * (hours * 3600 + minutes * 60))
    return F.when(zone == "", 0).otherwise(F.coalesce(named * 3600, offset))


def _seconds(text: Column, form: str, year: Column, month: Column, day: Column, first: int) -> Column:
    hour, minute, second = (_int(text, form, first + k) for k in range(3))
    days = F.datediff(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    able = (year >= 1) & (hour <= 24) & (minute < 60) & (second <= 60)
    zone = zone_seconds(F.regexp_extract(text, form, first + 3))
    return F.when(able, days.cast("long") * 86_400 + hour * 3600 + minute * 60 + second - zone)


def feed_seconds(text: Column) -> Column:
    text = F.trim(text)
    iso = _seconds(text, ISO, _int(text, ISO, 1), _int(text, ISO, 2), _int(text, ISO, 3), 4)
    short = F.regexp_extract(text, RFC, 3)
    year = _int(text, RFC, 3)
    year = F.when(F.length(short) > 2, year).when(year < 70, year + 2000).otherwise(year + 1900)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, RFC, 2))).cast("int")
    rfc = F.when(month > 0, _seconds(text, RFC, year, month, _int(text, RFC, 1), 4))
    return F.when(text.rlike(ISO), iso).when(text.rlike(RFC), rfc)


def not_future(seconds: Column, now: Column) -> Column:
    """Null if more than a day ahead."""
    return F.when(seconds <= now + FUTURE_S, seconds)


def civil_day(ts: Column, zone: str) -> Column:
    """The local day of a UTC time, as text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")
