"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that hold more than one row in HEAVY_SHARE are joined by broadcast; there can be at most HEAVY_SHARE of them.
HEAVY_SHARE = 2000
#: Rows that a key needs at least to count as hot; bytes that are broadcast for hot keys where rows may be large.
HEAVY_LEAST, HEAVY_BYTES = 1000, 16 << 20
#: Text that a Python task works on at a time.
SLICE_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table of few files is dealt out, a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: Sequence[str], base: str) -> str:
    """base, or base with underscores before it, so that no column of that name exists (names compare without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one that was set on the context.

    Only a session on one machine (a local master, as in tests) gets a temporary folder where neither is set; on a cluster that would be
    another folder on each machine, so it raises.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="siftwell-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared checkpoint folder, and read back: smaller than a checkpoint of rows.

    Shuffle files of the write are dropped as soon as it ends; the table doesn't need them. Later plans read the table lazily, so it stays
    until the folder is emptied, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/siftwell-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about ``most`` bytes in column ``at``, one row at least: what a task makes of a part stays small."""
    for batch in batches:
        n = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(at)), 0).cast(pa.int64())).to_numpy() if batch.num_rows else []
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(n, (n[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def annotate(df: DataFrame, text: str, field: T.StructField, build: Callable[[], Callable[[pa.Array], pa.Array]], keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns ``keep`` (default: all) and a column ``field`` that is computed batch by batch from the text column.

    ``build`` runs once per task and returns a function from a binary Arrow array (UTF-8, nulls kept) to the new column.
    Rows neither move nor change order, so there is no shuffle.
    """
    keep = list(df.columns if keep is None else keep)
    sent = list(dict.fromkeys([*keep, text]))
    inner = [f"k{i}" for i in range(len(sent))]  # names of columns may be anything, so they travel under numbers
    numbered = df.select(*(col(c).alias(k) for c, k in zip(sent, inner, strict=True)))
    schema = T.StructType([*numbered.schema.fields[: len(keep)], T.StructField("new", field.dataType)])

    def run(batches):
        fn = build()
        for batch in slices(batches, sent.index(text)):
            raw = batch.column(sent.index(text))
            raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), fn(raw)], names=schema.names)

    return numbered.mapInArrow(run, schema).toDF(*keep, field.name)


_built: dict[str, object] = {}


class Shared:
    """A broadcast value of bounded size, and what worker processes build from it. A worker keeps what it built last."""

    def __init__(self, spark: SparkSession, value):
        self.key, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def build(self, make: Callable):
        """make(value), once in each worker process."""
        if self.key not in _built:
            _built.clear()
            gc.collect()  # what an earlier stage built shouldn't stay with the worker
            pa.default_memory_pool().release_unused()
            _built[self.key] = make(self.broadcast.value)
        return _built[self.key]


def join_skewed(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "left", most_bytes: int = HEAVY_BYTES) -> DataFrame:
    """left ⋈ right on ``key``, where right holds each key once and ``counts`` (key, n) says how often left holds it.

    Keys with more than total / HEAVY_SHARE rows number fewer than HEAVY_SHARE, whatever the size of the input, so their part of
    ``right`` is broadcast and their rows stay where they are; all others are shuffled and none of them can be hot. Where ``counts`` has a
    column size (bytes of a key's row in right), the hottest keys of up to ``most_bytes`` together are broadcast, and any others go with
    the rest, where adaptive execution splits what is uneven.
    """
    heavy = counts.where(F.col("n") > max(HEAVY_LEAST, total // HEAVY_SHARE))
    if "size" in counts.columns:
        upto = F.sum("size").over(Window.orderBy(F.desc("n"), key))  # over fewer than HEAVY_SHARE rows
        heavy = heavy.withColumn("upto", upto).where(F.col("upto") <= most_bytes)
    heavy = cut(heavy.select(key))
    if heavy.isEmpty():
        return left.join(right, key, how)
    small = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi"))
    marked = left.join(F.broadcast(heavy.withColumn("_hot", F.lit(True))), key, "left")
    hot = marked.where(F.col("_hot")).drop("_hot").join(small, key, how)
    return hot.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how))
