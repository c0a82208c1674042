"""Page views and visitors over a visit log (article_id, visitor_id, visit_time)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def totals(log: DataFrame, today: str) -> DataFrame:
    """(article_id, pv, uv, pv_today, uv_today) in one pass."""
    now = F.to_date("visit_time") == F.lit(today).cast("date")
    return log.groupBy("article_id").agg(
        F.count("*").alias("pv"), F.countDistinct("visitor_id").alias("uv"), F.count_if(now).alias("pv_today"), F.countDistinct(F.when(now, F.col("visitor_id"))).alias("uv_today")
    )


def site(log: DataFrame, approximate: bool = False) -> DataFrame:
    """(pv, uv) of the site."""
    distinct = F.approx_count_distinct("visitor_id") if approximate else F.countDistinct("visitor_id")
    return log.agg(F.count("*").alias("pv"), distinct.alias("uv"))


def daily_sketches(log: DataFrame, *by: str) -> DataFrame:
    """(by..., day, visitors, views): a sketch of the visitors of each day, a few KB however many they are, to be stored and merged."""
    day = F.to_date("visit_time").alias("day")
    return log.groupBy(*by, day).agg(F.hll_sketch_agg(F.col("visitor_id").cast("string"), F.lit(14)).alias("visitors"), F.count("*").alias("views"))


def visitors_between(sketches: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """(by..., uv, pv) of any range of days, both ends in it, from daily sketches: distinct visitors within about two percent, views exactly.
    The visit log isn't read."""
    days = sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("uv"), F.sum("views").alias("pv"))


def visitor_state(log: DataFrame) -> DataFrame:
    """One row for each article and visitor: first and last view, and number of views."""
    return log.groupBy("article_id", "visitor_id").agg(F.min("visit_time").alias("first_view"), F.max("visit_time").alias("last_view"), F.count("*").alias("views"))


def with_zero(ids: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Counts for all ids that were asked for, 0 where there are none."""
    rest = [c for c in counts.columns if c != key]
    return ids.join(counts, key, "left").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in rest))


def by_period(articles: DataFrame, ts: str = "publish_time") -> DataFrame:
    """(year, month, n), latest first; undated ones before all others."""
    t = F.col(ts)
    return articles.groupBy(F.date_format(t, "yyyy").alias("year"), F.date_format(t, "MM").alias("month")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_first("year"), F.desc_nulls_first("month"))


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60, key: str = "ip", ts: str = "ts", order: str = "id") -> DataFrame:
    """requests with ``allowed``: windows begin at a key's first request and end when a later one comes more than ``seconds`` after.

    Where a window begins depends on the one before, so a key's requests pass by in order: one exchange, sorted, and a stream that holds
    the window's beginning and its count. Rows without a time come first and are allowed.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    dealt = requests.select(*requests.columns, F.xxhash64(key).alias("_k"), F.coalesce(micros, F.lit(-(2**62))).alias("_at")).repartition(key).sortWithinPartitions(key, "_at", order)

    def run(batches):
        now, start, n = None, None, 0
        for b in batches:
            keys, at = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            allowed, i = np.ones(len(at), bool), 0
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            for end in ends.tolist() if len(keys) else ():
                if keys[i] != now:
                    now, start, n = keys[i], None, 0
                while i < end:
                    if start is None or at[i] - start > seconds * 1_000_000:
                        start, n = int(at[i]), 0
                    stop = i + int(np.searchsorted(at[i:end], start + seconds * 1_000_000, "right"))
                    allowed[i:stop] = (n + np.arange(1, stop - i + 1) <= most) | (at[i:stop] == -(2**62))
                    n, i = n + stop - i, stop
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(allowed)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def per_window(requests: DataFrame, seconds: int = 60, key: str = "ip", ts: str = "ts") -> DataFrame:
    """Requests of each key in each clock-aligned window."""
    return requests.groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def is_today(ts: Column, today: str) -> Column:
    return F.to_date(ts) == F.lit(today).cast("date")
