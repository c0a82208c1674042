"""An inverted-file index of vectors: lists by nearest centre, stored as a partitioned table; a search reads the lists nearest to it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import nearest_to

#: Vectors that the centres are learned from, about and at most.
SAMPLE = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centres_of(vectors: DataFrame, lists: int, vector: str = "embedding", seed: int = 7, most: int = SAMPLE) -> np.ndarray:
    """Centres of directions by k-means in Spark, from all vectors or, where there are more than ``most``, from about that many of them."""
    known = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    n = known.count()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    chosen = known if n <= most else known.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < (most << 20) // n)
    units = chosen.withColumn("l", length).where("l > 0").select(array_to_vector(F.transform("v", lambda x: x / F.col("l"))).alias("features"))
    return _unit(np.array(KMeans(k=lists, seed=seed, maxIter=15).fit(units).clusterCenters()))


def build(vectors: DataFrame, path: str, lists: int = 32, key: str = "vec_id", vector: str = "embedding") -> None:
    """Write every vector to the list of its nearest centre, and the centres beside them. A list's rows come to few files; vectors that are
    null, or have no direction, are in no list, since no search can rank them."""
    spark, centres = vectors.sparkSession, centres_of(vectors, lists, vector)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series((_unit(np.stack(v.to_numpy()).astype(float)) @ shared.value.T).argmax(1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    usable = vectors.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    usable.select(key, vector, nearest(vector).alias("list")).repartition("list", F.pmod(F.xxhash64(key), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def lists_near(spark: SparkSession, path: str, target: Sequence[float], probes: int) -> list[int]:
    """The ``probes`` lists whose centres are nearest to the target."""
    rows = spark.read.parquet(f"{path}/centres").collect()  # as many as there are lists
    scores = _unit(np.array([r["centre"] for r in rows])) @ np.array(target, float)
    return [rows[i]["list"] for i in np.argsort(-scores)[:probes]]


def search(spark: SparkSession, path: str, target: Sequence[float], k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k nearest in the ``probes`` nearest lists; with as many probes as lists, of all."""
    near = lists_near(spark, path, target, probes)
    return nearest_to(spark.read.parquet(f"{path}/lists").where(F.col("list").isin(near)), list(target), k, key, vector)
