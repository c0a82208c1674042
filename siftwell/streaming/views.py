"""Views of articles with lasting state: a visitor counts once, however long ago the first view was, and a batch that is replayed counts once.

A batch's views are added up by article and visitor and written as a part of their own, named by the batch's id, which a replay overwrites.
Readers add the parts up. ``compact`` folds parts into one table, so that reading doesn't grow with the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEYS = ["article_id", "visitor_id"]


def _added(records: DataFrame) -> DataFrame:
    return records.groupBy(*KEYS).agg(F.min("first_view").alias("first_view"), F.max("last_view").alias("last_view"), F.sum("views").cast("long").alias("views"))


def record_views(batch: DataFrame, batch_id: int, path: str) -> None:
    """Record a batch of views (article_id, visitor_id, visit_time), for foreachBatch. The same batch again changes nothing."""
    own = batch.groupBy(*KEYS).agg(F.min("visit_time").alias("first_view"), F.max("visit_time").alias("last_view"), F.count("*").alias("views"))
    own.withColumn("batch", F.lit(int(batch_id))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/batches")


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The last batch that is folded into a table, and that table's name."""
    try:
        row = spark.read.parquet(f"{path}/compacted").orderBy(F.desc("upto")).first()
    except Exception as e:  # nothing was compacted yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1, None
    return row["upto"], row["name"]


def view_records(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, visitor_id, first_view, last_view, views) of all batches."""
    upto, name = _newest(spark, path)
    rows = spark.read.parquet(f"{path}/batches").where(F.col("batch") > upto).drop("batch")
    return _added(rows if name is None else rows.unionByName(spark.read.parquet(f"{path}/tables/{name}")))


def compact(spark: SparkSession, path: str) -> None:
    """Fold all batches that are there into one table; readers see it once it is complete. Batches that are folded mustn't be replayed, so
    call it between runs of the stream."""
    upto = spark.read.parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    name = uuid.uuid4().hex
    view_records(spark, path).write.parquet(f"{path}/tables/{name}")
    spark.createDataFrame([(upto, name)], "upto long, name string").coalesce(1).write.mode("append").parquet(f"{path}/compacted")


def article_counts(records: DataFrame) -> DataFrame:
    """(article_id, pv, uv) from the records."""
    return records.groupBy("article_id").agg(F.sum("views").alias("pv"), F.count("*").alias("uv"))


VIEW = T.StructType([T.StructField("first_view", T.LongType()), T.StructField("last_view", T.LongType()), T.StructField("views", T.LongType())])
VIEWS = "article_id long, visitor_id long, first_view timestamp, last_view timestamp, views long, is_new boolean"


class ViewProcessor(StatefulProcessor):
    """First and last view (microseconds) and number of views of one article and visitor; nothing expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("view", VIEW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([b["at"] for b in rows]).astype("int64")
        known = self.state.get()
        first, last, n = (int(x) for x in known) if known is not None else (int(times.min()), int(times.max()), 0)
        new, first, last, n = known is None, min(first, int(times.min())), max(last, int(times.max())), n + len(times)
        self.state.update((first, last, n))
        yield pd.DataFrame({"article_id": [key[0]], "visitor_id": [key[1]], "first_view": pd.to_datetime([first], unit="us"), "last_view": pd.to_datetime([last], unit="us"), "views": [n], "is_new": [new]})

    def close(self) -> None:
        pass


def running_views(log: DataFrame) -> DataFrame:
    """After each micro-batch, the record of every article and visitor that it holds (ids are long), and whether it is a new one. State is
    three numbers a visitor and is kept for good; the session's state store has to be RocksDB, which keeps it on disk."""
    timed = log.select(*KEYS, F.unix_micros(F.col("visit_time").cast("timestamp")).alias("at"))
    return timed.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=ViewProcessor(), outputStructType=VIEWS, outputMode="Update", timeMode="None")
