"""Does a result fit the keyword it was searched for? Fragments of keywords, relevance, and pages that only ask for a captcha."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import alternation, contains_any

# Phrases of pages that keep robots out (fixed values).
ROBOT_PHRASES = (
    "验证码", "captcha", "security check", "verify you are human", "unusual traffic", "automated requests", "ip address has been blocked", "please verify", "i'm not a robot",
    "recaptcha", "安全验证",
)
_LATIN, _CJK = re.compile(r"[a-z0-9][a-z0-9._-]*[a-z0-9]|[a-z0-9]"), re.compile("[一-鿿]+")


def fragments(keyword: str) -> list[str]:
    """Latin words of two letters or more, then each run of ideographs with its pairs; no ideographs twice. Keywords are few and short."""
    low = keyword.strip().lower()
    runs = _CJK.findall(low)
    pieces = (run[i : i + n] for run in runs for n in (len(run), 2) for i in range(len(run) - n + 1))
    return [w for w in _LATIN.findall(low) if len(w) > 1] + list(dict.fromkeys(pieces))


def is_relevant(keyword: str, title: Column, snippet: Column) -> Column:
    """A title that isn't empty, no excluded word, and the keyword itself, a fragment in the title, or two thirds of the fragments anywhere."""
    low = keyword.strip().lower()
    title, snippet = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(snippet, F.lit("")))
    both = F.concat(title, F.lit(" "), snippet)
    whole = both.contains(low) if _CJK.search(low) else both.rlike(rf"\b{alternation([low])}\b")
    parts = fragments(keyword)
    count = reduce(lambda a, b: a + b, [both.contains(p).cast("int") for p in parts], F.lit(0))
    some = F.lit(False) if not parts else title.rlike(alternation(parts)) | (count >= max(1, (2 * len(parts) + 2) // 3))
    return ~F.trim(title).isin("", "no title") & ~contains_any(both, V.EXCLUDED_KEYWORDS) & (whole | some)


def asks_for_human(page: Column) -> Column:
    return contains_any(page, ROBOT_PHRASES)


def variants(keywords: list[str], most: int = 4) -> list[str]:
    """Distinct keywords without regard to case, in order."""
    seen: dict[str, str] = {}
    for k in keywords:
        if k.strip():
            seen.setdefault(k.strip().lower(), k.strip())
    return list(seen.values())[:most]


def baidu_window(start: Column, end: Column) -> Column:
    """The time window part of a search address."""
    raw = F.concat(F.lit("stf="), F.unix_timestamp(start).cast("string"), F.lit(","), F.unix_timestamp(end).cast("string"), F.lit("|stftype=1"))
    return F.concat(F.lit("&gpc="), F.base64(raw.cast("binary")))


def time_filter(engine: Column, time_range: Column, now: Column) -> Column:
    """What a search address adds for a time range (day, week, month, year); nothing for all times and for unknown engines or ranges."""
    out = F.lit("")
    for name, parts in V.SERP_TIMES.items():
        for span, part in parts.items():
            out = F.when((engine == name) & (time_range == span), part).otherwise(out)
    days = F.when(time_range == "day", 1).when(time_range == "week", 7).when(time_range == "month", 30).when(time_range == "year", 365)
    return F.when((engine == "baidu") & days.isNotNull(), baidu_window(now - F.make_dt_interval(days), now)).otherwise(out)
