"""Page types: results pages, listings, logins, errors, paywalls and forums, told by points from address, title and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from . import values as V
from .text import alternation

ENOUGH = 5
ORDER = ("serp", "listing", "login", "error", "paywall", "forum")


def _points(rules) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in rules])


def _lines(content: Column) -> Column:
    return F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")


def scores(content: Column, url: Column, title: Column) -> dict[str, Column]:
    """Points of each type."""
    url, title = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    lines = _lines(content)
    n_lines = F.size(lines)
    result_links = F.size(F.filter(lines, lambda x: x.rlike(r"\[([^\]]+)\]\(https?://[^\)]+\)") & (F.length(F.trim(x)) < 200)))
    link_lines = F.size(F.filter(lines, lambda x: x.contains("[") & x.contains("](")))
    of = lambda words: url.rlike(alternation(words))
    segments = F.split(urls.path(url), "/")
    short = F.length(F.trim(content)) < 500
    return {
        "serp": _points([
            (urls.netloc(url).isin(*V.SERP_ROOTS) & (F.rtrim(urls.path(url), F.lit("/")) == "") & (urls.query(url) == ""), 5),
            (title.rlike(alternation(V.SERP_TITLES)), 3), (of(V.SERP_URLS), 3), (content.rlike("|".join(V.SERP_UI)), 2),
            ((result_links >= 4) & (result_links / n_lines > 0.3), 3), (title.rlike(alternation(V.SERP_TITLE_WORDS)), 1),
        ]),
        "listing": _points([
            (of(V.LISTING_URLS), 3), (F.regexp_count(content, F.lit(r"\d{4}[-/]\d{2}[-/]\d{2}")) >= 5, 2),
            (F.regexp_count(content, F.lit("阅读全文|Read more|继续阅读|查看全文")) >= 3, 2),
            ((F.regexp_count(content, F.lit(r"(?m)^#{1,3}\s")) > 5) & (F.regexp_count(content, F.lit("(?m)^[A-Za-z\u4e00-\u9fff].{80,}")) < 2), 2),
            (content.rlike(r"(?i)第\s*\d+\s*页|page\s*\d+\s*of\s*\d+|共\s*\d+\s*页"), 2), ((link_lines / n_lines > 0.4) & (link_lines >= 5), 2),
        ]),
        "login": _points([(F.arrays_overlap(segments, F.array(*map(F.lit, V.LOGIN_SEGMENTS))), 3), (content.rlike("(?i)" + alternation(V.LOGIN_TEXT)), 2)]),
        "error": _points([(title.rlike(alternation(V.ERROR_TITLES)), 3), (short & F.lower(content).rlike(alternation(V.ERROR_TITLES)), 2)]),
        "paywall": _points([(of(V.PAYWALL_URLS), 3), *((content.rlike(p), 2) for p in V.PAYWALL_TEXT)]),
        "forum": _points([(of(V.FORUM_URLS), 3), (content.rlike("|".join(V.FORUM_UI)), 2)]),
    }


def classify(content: Column, url: Column, title: Column) -> Column:
    """struct(page_type, confidence): the first type in order with enough points, else unknown."""
    s = scores(content, url, title)
    out = F.struct(F.lit("unknown").alias("page_type"), F.lit(0.0).alias("confidence"))
    for name in reversed(ORDER):
        out = F.when(s[name] >= ENOUGH, F.struct(F.lit(name).alias("page_type"), F.least(s[name] / 8, F.lit(0.95)).alias("confidence"))).otherwise(out)
    return F.when(F.coalesce(content, F.lit("")) == "", F.struct(F.lit("unknown").alias("page_type"), F.lit(0.0).alias("confidence"))).otherwise(out)
