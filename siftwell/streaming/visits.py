"""Structured Streaming forms of the visit and request operators."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls


def with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark needs a timestamp with zone; NTZ columns are cast."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily_views(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, article_id, pv, uv approximately) in tumbling windows of a day."""
    return with_event_time(log, "visit_time", late).groupBy(F.window("visit_time", "1 day").alias("w"), "article_id").agg(
        F.count("*").alias("pv"), F.approx_count_distinct("visitor_id").alias("uv")
    ).select(F.to_date("w.start").alias("day"), "article_id", "pv", "uv")


def first_visits(log: DataFrame) -> DataFrame:
    """The first view of each visitor and article, for good: state is one key a visitor and article and never expires, so that nobody counts
    twice. See views.record_views for state in tables."""
    return log.dropDuplicates(["article_id", "visitor_id"])


def unseen_pages(pages: DataFrame, keep: str = "3 days", ts: str = "crawled_at") -> DataFrame:
    """Pages whose normalised address hasn't come up within ``keep``."""
    return with_event_time(pages.withColumn("_u", urls.normalize_url(F.col("url"))), ts, keep).dropDuplicatesWithinWatermark(["_u"]).drop("_u")


def unseen_across_days(pages: DataFrame, history: DataFrame, keep: str = "3 days", ts: str = "crawled_at") -> DataFrame:
    """unseen_pages that a stored history (url) doesn't have either; the history is read anew for every micro-batch."""
    known = history.select(urls.normalize_url(F.col("url")).alias("_u")).distinct().withColumn("_known", F.lit(True))
    new = unseen_pages(pages, keep, ts).withColumn("_u", urls.normalize_url(F.col("url")))
    return new.join(known, "_u", "left").where(F.col("_known").isNull()).drop("_u", "_known")


def poll_feeds(spark, folder: str, now: str, hours: int = 24, most: int = 10, keep: str = "3 days") -> DataFrame:
    """Fresh entries of feeds that a fetcher drops as JSON lines (feed_url, xml) into a folder; each address once within ``keep``.

    Start it with trigger(availableNow=True) to poll: every file is read once, and the query's checkpoint tells which ones were. What a
    feed's document holds travels as one list, so freshness and caps apply to it as in a batch.
    """
    from ..sources.readers import fresh_lists, parsed_feeds

    feeds = spark.readStream.schema("feed_url string, xml string").json(folder)
    return unseen_pages(fresh_lists(parsed_feeds(feeds), now, hours, most), keep, "published")


def moving_quality(runs: DataFrame) -> DataFrame:
    """(source_id, quality, runs) after each micro-batch of runs (source_id, visit_time, score): state is one number and a count a source.

    The first score counts as it is, later ones by three tenths; each step is rounded to two decimals, half up. A value of 0 is unset.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (0.0, 0)
        for s in pd.concat(list(batches)).sort_values("visit_time")["score"].tolist():
            value, n = floor((s if value == 0 else 0.7 * value + 0.3 * s) * 100 + 0.5) / 100, n + 1
        state.update((value, n))
        yield pd.DataFrame({"source_id": key[0], "quality": [value], "runs": [n]})

    return runs.groupBy("source_id").applyInPandasWithState(fold, "source_id long, quality double, runs int", "quality double, runs int", "update", GroupStateTimeout.NoTimeout)


def visitor_state(log: DataFrame) -> DataFrame:
    """Running first and last view and number of views of each article and visitor; for update mode."""
    return log.groupBy("article_id", "visitor_id").agg(F.min("visit_time").alias("first_view"), F.max("visit_time").alias("last_view"), F.count("*").alias("views"))


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """(ip, id, allowed): windows begin at a key's first request. State is two numbers a key and times out with its window.

    Within a micro-batch requests are taken by time; batches are taken as they come.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        at = rows["ts"].astype("int64") // (1000 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1)
        allowed = []
        for t in at.tolist():
            if start is None or t - start > seconds * 1_000_000:
                start, n = t, 0
            n += 1
            allowed.append(n <= most)
        state.update((start, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, start // 1000 + seconds * 1000 + 1))
        yield pd.DataFrame({"ip": key[0], "id": rows["id"].to_numpy(), "allowed": allowed})

    timed = with_event_time(requests, "ts", late)
    return timed.groupBy("ip").applyInPandasWithState(fold, "ip string, id long, allowed boolean", "start long, n int", "append", GroupStateTimeout.EventTimeTimeout)
