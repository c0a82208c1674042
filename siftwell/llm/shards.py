"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, without looking at a row: a sample without replacement, so every
assignment of rows to shards is equally likely. Tasks permute their rows locally and deal them out by these counts, and each row draws a
random key. Rows are exchanged once, by shard and range of keys (a cell), and permuted again: a row's slot is the rank of its key in its
shard, told by its rank in the cell and the rows of the cells before. Cells are counted from the same random numbers, without the rows.

The matrix has a column for each shard, and is never held as a whole. Ranges of partitions are halved again and again; each half's share
of every shard is drawn with a generator that the range seeds, so a task derives its own row of the matrix from the partitions' row
counts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

SHARDS = 8
#: Bytes of text in a cell, about; a cell is permuted by one task.
CELL_BYTES = 32 << 20
#: Numbers of rows that numpy's generator takes.
LIBRARY_RANGE = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard; they differ by one at most."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def hypergeometric(rng: np.random.Generator, left: int, right: int, n: int) -> int:
    """How many of n rows drawn without replacement from left + right are of the left.

    Beyond the library's range the distribution is summed up around its mode, from ratios of neighbouring probabilities: all that lies
    within 14 standard deviations, which is all but 1e-40 of it.
    """
    if max(left, right) < LIBRARY_RANGE:
        return int(rng.hypergeometric(left, right, n))
    total, mode = left + right, (n + 1) * (left + 1) // (left + right + 2)
    reach = 20 + int(14 * np.sqrt(n * (left / total) * (right / total) * ((total - n) / max(1, total - 1))))
    low, high = max(0, n - right, mode - reach), min(left, n, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log((left - k) / (k + 1)) + np.log((n - k) / (right - n + k + 1))
    p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(p - p.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def draw(rng: np.random.Generator, caps: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn without replacement fall to each shard of sizes ``caps``."""
    if caps.sum() < LIBRARY_RANGE:
        return rng.multivariate_hypergeometric(caps, n, method="marginals")
    half = len(caps) // 2
    if not half:
        return np.array([n])
    k = hypergeometric(rng, int(caps[:half].sum()), int(caps[half:].sum()), n)
    return np.concatenate([draw(rng, caps[:half], k), draw(rng, caps[half:], n - k)])


def matrix_row(counts: np.ndarray, caps: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: how many of the partition's rows go to each shard."""
    lo, hi, sums = 0, len(counts), np.concatenate([[0], np.cumsum(counts)])
    caps = caps.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), caps, int(sums[mid] - sums[lo]))
        lo, hi, caps = (lo, mid, left) if part < mid else (mid, hi, caps - left)
    return caps


def places_of(counts: np.ndarray, caps: np.ndarray, part: int, seed: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, cell, key) of each row of a partition, in order: always the same for one seed."""
    rng = np.random.default_rng([seed, part, 1])
    shard_ = rng.permutation(np.repeat(np.arange(len(caps), dtype=np.int32), matrix_row(counts, caps, part, seed)))
    key = rng.integers(0, 2**63 - 1, len(shard_))
    return shard_, (((key >> 31) * cells) >> 32).astype(np.int32), key


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 0, cell_rows: int | None = None, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """docs with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); all columns and rows kept, one exchange.

    Law ``rows``: shard sizes differ by at most one. Columns that already have these names are replaced. An empty frame gives an empty one.
    Nulls, empty and very long texts and repeated rows are rows like all others; a row has to fit a task. Fewer rows than ``shards`` leave
    shards empty. A cell holds about ``cell_rows`` rows, or as many as CELL_BYTES of text hold on average. The frame must read the same rows
    in the same partitions each time, as a stored table does; a task that meets another number of rows than was counted fails instead of
    dealing wrongly.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    inner = [f"k{i}" for i in range(len(kept))]  # names of columns may be anything, so they travel under numbers
    part = "part"
    source = docs.select(*(col(c).alias(k) for c, k in zip(kept, inner, strict=True)), F.spark_partition_id().alias(part))
    texts = [F.coalesce(F.octet_length(k), F.lit(0)) for k in inner if isinstance(source.schema[k].dataType, T.StringType | T.BinaryType)]
    tallies = source.groupBy(part).agg(F.count("*"), F.sum(sum(texts, F.lit(64)).cast("long"))).collect()
    counted = {r[0]: r[1] for r in tallies}
    if cell_rows is None:
        cell_rows = max(1, CELL_BYTES * sum(counted.values()) // max(1, sum(r[2] for r in tallies)))
    counts = np.array([counted.get(p, 0) for p in range(max(counted, default=-1) + 1)], np.int64)
    caps = shard_sizes(int(counts.sum()), shards)
    cells = max(1, -(-int(caps.max()) // cell_rows))
    shared = spark.sparkContext.broadcast((counts, caps))
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField("shard", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("key", T.LongType())])

    def deal(batches):
        counts, caps = shared.value
        places, at, p = None, 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            if places is None:
                p = batch.column(len(kept))[0].as_py()
                places = places_of(counts, caps, p, seed, cells)
            mine = [x[at : at + batch.num_rows] for x in places]
            at += batch.num_rows
            if len(mine[0]) < batch.num_rows:
                raise RuntimeError(f"partition {p} has more rows than were counted")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *map(pa.array, mine)], names=schema.names)
        if places is not None and at != len(places[0]):
            raise RuntimeError(f"partition {p} has {at} rows; {len(places[0])} were counted")

    def tally(batches):
        counts, caps = shared.value
        for batch in batches:
            for p in batch.column(0).to_pylist():
                shard_, cell, _ = places_of(counts, caps, p, seed, cells)
                found, n = np.unique(shard_.astype(np.int64) * cells + cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((found // cells).astype(np.int32)), pa.array((found % cells).astype(np.int32)), pa.array(n.astype(np.int64))], names=["shard", "cell", "n"])

    sizes = spark.range(0, len(counts), 1, max(1, len(counts))).mapInArrow(tally, "shard int, cell int, n long").groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    first = sizes.select("shard", "cell", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key")) - 1
    numbered = source.mapInArrow(deal, schema).withColumn("rank", rank).join(first, ["shard", "cell"])
    return numbered.select(*(F.col(k).alias(c) for c, k in zip(kept, inner, strict=True)), F.col("shard").alias(names[0]), (F.col("before") + F.col("rank")).alias(names[1]))
