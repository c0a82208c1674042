"""Writing collected pages, digests and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import append_fingerprints


def write_pages(pages: DataFrame, path: str) -> None:
    """Append pages, partitioned by task; rows of a task come to few files."""
    pages.repartition("task_id").write.mode("append").partitionBy("task_id").parquet(path)


def replace_tasks(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the tasks in ``rows``; others stay."""
    rows.repartition("task_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def insert_fingerprints(new: DataFrame, path: str) -> None:
    """Append fingerprints whose (url_hash, digest_date) isn't stored. Only partitions of the new dates are read.

    There is no lock: two writers at once may both store a key. Rows carry when and by whom they were written, and ``fingerprints`` counts
    the first of a key only.
    """
    spark = new.sparkSession
    new = new.dropDuplicates(["url_hash", "digest_date"])
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], new.schema)
    fresh = append_fingerprints(old.join(new.select("digest_date").distinct(), "digest_date", "left_semi"), new)
    fresh.withColumn("written_at", F.current_timestamp()).withColumn("writer", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("digest_date").parquet(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Stored fingerprints, one row for each (url_hash, digest_date): the first written, of equal times the first writer's. Rows of tables
    that were made without these columns count as the earliest. Filters on digest_date reach the partitions."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    others = [c for c in rows.columns if c not in ("url_hash", "digest_date", "written_at", "writer")]
    first = F.min_by(F.struct(*others), F.struct("written_at", "writer")) if "writer" in rows.columns else F.first(F.struct(*others))
    return rows.groupBy("url_hash", "digest_date").agg(first.alias("_r")).select("url_hash", *(f"_r.{c}" for c in others), "digest_date")


def append_rounds(rounds: DataFrame, path: str) -> None:
    """Append optimisation rounds, partitioned by the month they were made in, so that old months can be dropped."""
    rounds.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """One Markdown text a line group, in files by task: documents (id, markdown)."""
    documents.select(F.col("id").alias("task_id"), F.col("markdown").alias("value")).repartition("task_id").write.mode("overwrite").partitionBy("task_id").text(path)


def to_daily_logs(tasks: DataFrame, converted: DataFrame) -> DataFrame:
    """Drafts of daily logs of finished digests that have none yet (``converted`` holds task_id)."""
    done = tasks.where((F.col("status") == 3) & (F.col("task_type") == "digest")).join(converted, tasks.id == converted.task_id, "left_anti")
    return done.select(F.col("id").alias("task_id"), F.col("digest_date").alias("log_date"), F.col("ai_title").alias("title"), F.col("ai_full_content").alias("content"), F.lit(False).alias("is_public"))


def to_articles(tasks: DataFrame, converted: DataFrame) -> DataFrame:
    """Drafts of finished tasks that have none yet (``converted`` holds task_id)."""
    done = tasks.where(F.col("status") == 3).join(converted, tasks.id == converted.task_id, "left_anti")
    return done.select(F.col("id").alias("task_id"), F.col("ai_title").alias("title"), F.col("ai_full_content").alias("content"), F.col("ai_summary").alias("summary"), F.lit(2).alias("status"))
