"""Dates and times as web pages write them, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order they are tried.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
    "yyyy-M-d", "yyyy年M月d日", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy",
)


def normalize_datetime(text: Column) -> Column:
    """ISO 8601, or null if no format fits. A local time stays as it is, with its offset behind it where the text has one; a Z counts as
    no offset, as in the formats that end in it."""
    zone = r"^(.*T\d{2}:\d{2}:\d{2})([+-]\d{2}):?(\d{2})$"
    trimmed = F.trim(text)
    plain = F.regexp_replace(trimmed, zone, "$1")
    offset = F.when(trimmed.rlike(zone), F.regexp_replace(trimmed, zone, "$2:$3")).otherwise("")
    found = F.date_format(F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS]), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(found, offset)


def utc(text: Column) -> Column:
    """The moment of an ISO text, by its offset, or as UTC where it has none."""
    iso = normalize_datetime(text)
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(F.concat(iso, F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def relative_time(ts: Column, now: Column) -> Column:
    """How long ago, in words."""
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    ago = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(name))
    return F.when(s < 60, "刚刚").when(s < 3600, ago(60, "分钟前")).when(s < 86400, ago(3600, "小时前")).when(s < 2592000, ago(86400, "天前")).when(s < 31536000, ago(2592000, "个月前")).otherwise(ago(31536000, "年前"))


def time_range(hours: Column) -> Column:
    """The search window for an age in hours."""
    return F.when(hours <= 24, "day").when(hours <= 168, "week").when(hours <= 720, "month").otherwise("year")
