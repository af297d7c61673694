"""Answers of servers as Columns: charset, delays, reasons, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semrank.functions import dates

# Seconds to stay away where a refusal doesn't say, and from where a number is a date.
UNSPECIFIED_S, UNIX_TIME = 60, 1_000_000_000


def charset(content_type: Column) -> Column:
    """The charset parameter of a Content-Type, without quotes; null if there is none."""
    pairs = F.transform(F.slice(F.split(content_type, ";"), F.lit(2), F.size(F.split(content_type, ";"))), lambda p: F.split(p, "=", 2))
    named = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.lower(F.trim(F.get(p, 0))) == "charset"))
    return F.regexp_replace(F.trim(F.get(F.get(named, 0), 1)), "^[\"']+|[\"']+$", "")


def delay_seconds(value: Column, now: Column) -> Column:
    """Seconds from now of a header: seconds, a Unix time or an HTTP date; null if it is none of these."""
    typed = F.trim(value)
    number = F.when(typed.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), typed.cast("double"))
    when = F.when(number.isNull(), dates.feed_seconds(typed)).cast("double")
    seconds = F.coalesce(F.when(number > UNIX_TIME, number - now).otherwise(number), when - now)
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def requested_delay(status: Column, retry_after: Column, reset: Column, now: Column) -> Column:
    """How long a refusal (429, or 503 with Retry-After) asks to stay away; null for other answers."""
    stated = delay_seconds(retry_after, now)
    return F.when((status == 429) | ((status == 503) & stated.isNotNull()), F.coalesce(stated, delay_seconds(reset, now), F.lit(float(UNSPECIFIED_S))))


def cooldown(status: Column, retry_after: Column, remaining: Column, reset: Column, now: Column) -> Column:
    """requested_delay(), or the time until the allowance is renewed where an answer spent the last of it."""
    left = F.when(F.trim(remaining).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.trim(remaining).cast("double"))
    return F.coalesce(requested_delay(status, retry_after, reset, now), F.when(left < 1, delay_seconds(reset, now)))


def reason(kind: Column, status: Column, wait: Column, message: Column) -> Column:
    """Why a source couldn't be refreshed, as a clause."""
    return (
        F.when(kind == "offline", "no internet connection").when(kind == "timedOut", "the server took too long to answer")
        .when((kind == "http") & status.isin(404, 410), F.concat(F.lit("the feed is gone (HTTP "), status.cast("string"), F.lit(")")))
        .when(kind == "http", F.concat(F.lit("the server answered HTTP "), status.cast("string")))
        .when((kind == "rateLimited") & (wait >= 0), F.concat(F.lit("the server asked to wait "), F.ceil(wait).cast("string"), F.lit(" s")))
        .when(kind == "rateLimited", "the server asked to slow down").when(kind == "notAFeed", "the address doesn't return a feed").otherwise(message)
    )


def redacted(detail: Column, key: Column, limit: int = 300) -> Column:
    """The start of a message without a secret, which goes before the cut so that none of it is left at the end."""
    return F.left(F.replace(detail, key, F.lit("<key>")), F.lit(limit))


def seconds_of_age(typed: Column) -> Column:
    """Of 38m, 7h, 2d; 0 for anything else."""
    unit, count = F.right(typed, F.lit(1)), F.regexp_extract(typed, r"^([0-9]+(?:\.[0-9]+)?)[mhd]$", 1)
    return F.when(count != "", F.nullif(count, F.lit("")).cast("double") * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86_400)).otherwise(0.0)


def year_before(ts: Column) -> Column:
    return ts - F.expr("INTERVAL 1 YEAR")
