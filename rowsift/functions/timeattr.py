"""Durations, time buckets and calendar attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
CALENDAR = frozenset("hour day week month year".split())


def seconds_of(text: str) -> int | None:
    m = re.fullmatch(r"\s*\+?(\d+)([smhd])\s*", text)
    return int(m.group(1)) * _UNITS[m.group(2)] or None if m else None


def is_duration(text: str) -> bool:
    return seconds_of(text) is not None or text.strip().lower() in CALENDAR


def relative(text: str, now: int) -> int | None:
    """Epoch seconds of now, now-5m, now+1h."""
    m = re.fullmatch(r"\s*now(?:([+-])(.+))?\s*", text)
    if not m:
        return None
    if not m.group(1):
        return now
    n = seconds_of(m.group(2))
    return None if n is None else now + n * (1 if m.group(1) == "+" else -1)


def bucket_label(epoch: Column, bucket: str) -> Column:
    """Label of the bucket of an epoch second; a fixed bucket truncates toward zero."""
    n = seconds_of(bucket)
    if n is not None:
        whole = (epoch - F.when(epoch >= 0, F.pmod(epoch, F.lit(n))).otherwise(-F.pmod(-epoch, F.lit(n)))).cast("long")
        return F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ts = F.timestamp_seconds(epoch)
    unit = bucket.strip().lower()
    if unit == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return F.date_format(ts, {"hour": "yyyy-MM-dd'T'HH':00:00Z'", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def attribute(fn: str, epoch: Column) -> Column:
    ts = F.timestamp_seconds(epoch)
    if fn == "hour_of_day":
        return F.hour(ts).cast("long")
    day = F.weekday(ts)
    return (day + 1).cast("long") if fn == "day_of_week" else day >= 5
