"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Vectors are centred, projected on their principal axes and rotated so that the signs lose least (iterative quantisation); the signs are a
code of at most 64 bits. A code is split into substrings and each has an index of its own. If two codes differ in at most R bits, then some
of m substrings differs in at most R // m bits, so probing every index block within that distance meets every code within R. What is met is
compared as a whole code and then ranked by the exact cosine of the vectors.

R is learned: the smallest radius that keeps nearly all true neighbours of a sample. Queries that find fewer than k rows within R are
searched again with wider radii, up to all bits, so every query gets its k rows. How many substrings there are is learned too: as many as
make the fewest comparisons at R. Where true neighbours lie far apart (R near half of the bits), few blocks can be skipped and two
substrings remain.

Index rows are dealt once for each substring, by block; a block of many rows is divided, and queries come to all parts. A task holds one
part's rows and lets queries pass by in a stream, so neither rows nor queries are copied by each other's number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, col, cut, store

#: About so many vectors, those whose hash is below a threshold, and queries among them, teach the rotation and the radius.
SAMPLE, SAMPLE_QUERIES = 10_000, 400
#: Share of the sample's true neighbours that the radius must hold.
WITHIN = 0.985
#: Numbers of substrings that are weighed; comparisons that take as long as dealing a row once more.
SUBSTRINGS, MOVE = (2, 4, 8), 2_000
#: Leading bits of a substring that name a block; rows of a block that one task holds; pairs compared at a time; results that it holds.
PREFIX, PART, TILE, HELD = 8, 1 << 17, 1 << 20, 1 << 20


@dataclass
class Rotation:
    """Centre, projection to bits, and the radius within which neighbours are searched."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def code(self, unit: np.ndarray) -> np.ndarray:
        """64-bit codes of unit vectors; unused high bits are zero."""
        on = (unit - self.mean) @ self.axes > 0
        wide = np.zeros((len(unit), 64), bool)
        wide[:, 64 - self.bits :] = on
        return np.packbits(wide, axis=1).view(">u8").reshape(-1).astype(np.uint64)

    def pieces(self, count: int) -> list[tuple[int, int]]:
        """Lowest bit and size of each substring."""
        count = min(count, self.bits)
        ends = [self.bits * i // count for i in range(count + 1)]
        return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def learn(unit: np.ndarray, k: int, within: float = WITHIN, queries: int = SAMPLE_QUERIES, rounds: int = 30) -> Rotation:
    """Fit on unit vectors. A sample's neighbours are farther than those among all rows, so the radius errs to the safe side."""
    mean = unit.mean(0)
    x = unit - mean
    bits = min(64, unit.shape[1])
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :bits]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    found = Rotation(mean, axes @ r, bits)
    code, q = found.code(unit), min(queries, len(unit))
    near = unit[:q] @ unit.T
    near[np.arange(q), np.arange(q)] = -2
    top = np.argsort(-near, axis=1, kind="stable")[:, :k]
    far = np.bitwise_count(code[:q, None] ^ code[top])[near[np.arange(q)[:, None], top] > -2]
    if len(far):
        found.radius = int(np.quantile(far, within, method="higher"))
    return found


def usable(vector: str) -> Column:
    """True for a vector that isn't null, holds no null or non-finite component, and isn't zero."""
    v = col(vector)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; one that is narrower than ``width`` goes on with zeros, which changes no cosine between vectors of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _norm(scaled: np.ndarray) -> np.ndarray:
    return np.sqrt((scaled * scaled).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / _norm(scaled)[:, None]


def blocks_within(values: np.ndarray, size: int, prefix: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and block of every block of a substring's index that may hold a value at most ``most`` bits away."""
    all_ = np.arange(1 << prefix, dtype=np.uint64)
    own = values >> np.uint64(size - prefix)
    return np.nonzero(np.bitwise_count(own[:, None] ^ all_) <= most)


def substrings_for(bits: int, radius: int, asked: int) -> int:
    """The number of substrings for which dealing rows and comparing them with the queries that probe their blocks costs least."""

    def cost(m: int) -> float:
        p = min(PREFIX, bits // m)
        return m * (asked * sum(comb(p, i) for i in range(min(p, radius // m) + 1)) / 2**p + MOVE)

    return min((m for m in SUBSTRINGS if m <= bits), key=cost, default=1)


def best_of(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, id, score) the k best of each query, ties to the smaller id; sorted."""
    found = found[np.lexsort((found["id"], -found["score"], found["q"]))]
    return found[np.arange(len(found)) - np.searchsorted(found["q"], found["q"]) < k]


_FOUND = np.dtype([("q", np.int64), ("id", np.int64), ("score", np.float64)])


def compare(rows: tuple, asked: tuple, piece: int, pieces: Sequence[tuple[int, int]], radius: int, k: int) -> np.ndarray:
    """The k best pairs of each query among rows within the radius that meet it in this substring's index, and in none before it.

    rows and asked are (ids, codes, vectors, norms); vectors are scaled by powers of two, so that their cosines are exact.
    """
    (ids, codes, x, x_norm), (qids, qcodes, q, q_norm) = rows, asked
    most = radius // len(pieces)
    out = [np.empty(0, _FOUND)]
    step = max(1, min(len(qids), 64))
    width = max(1, TILE // step)
    for s in range(0, len(qids), step):
        for t in range(0, len(ids), width):
            cut_ = slice(t, t + width)
            differ = qcodes[s : s + step, None] ^ codes[cut_]
            good = np.bitwise_count(differ) <= radius
            for i, (low, size) in enumerate(pieces[: piece + 1]):
                near = np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << size) - 1)) <= most
                good &= near if i == piece else ~near
            good &= qids[s : s + step, None] != ids[cut_]
            if not good.any():
                continue
            cosine = np.where(good, (q[s : s + step] @ x[cut_].T) / q_norm[s : s + step, None] / x_norm[cut_], -np.inf)
            n = cosine.shape[1]
            if n > k:  # everything at or above the k-th best, so that ties are settled exactly
                least = np.partition(cosine, n - k, axis=1)[:, n - k, None]
                good &= cosine >= np.nextafter(np.maximum(least, -2), -np.inf) - 1e-12
            r, c = np.nonzero(good)
            found = np.empty(len(r), _FOUND)
            found["q"], found["id"] = qids[s + r], ids[t + c]
            found["score"] = (q[s + r] * x[t + c]).sum(axis=1) / (q_norm[s + r] * x_norm[t + c])
            out.append(best_of(found, k))
    return best_of(np.concatenate(out), k)


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", substrings: int | None = None, sample: int = SAMPLE, part: int = PART, within: float = WITHIN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects its k nearest other rows by cosine, ties to the smaller id.

    Null, zero and non-finite vectors take no part, nor do rows with a null id; an id that isn't a number raises. Vectors of several
    widths are compared as if the narrower went on with zeros. Rows that repeat an id count once (the one whose vector sorts first). A
    query gets all other rows if they are fewer than k. No usable vector gives an empty result. Every usable row is indexed; only rotation
    and radius are learned from about ``sample`` rows, whatever the table's size. A very wide vector has to fit a task PART times.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(key).cast("long").alias("id"), col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("id").isNotNull() & usable("v"))
    rows = store(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")))
    width, total, asking = rows.agg(F.max(F.size("v")), F.count("*"), F.count_if("is_query")).first()
    if not total or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # hashes are uniform over +-2^63
    picked = rows.where(F.xxhash64("id") <= int(-(2**63) + min(1.0, sample / total) * (2**64 - 1)) if total > sample else F.lit(True)).select("v").toArrow()
    rotation = learn(_unit(_matrix(picked.column(0).combine_chunks(), width)) if picked.num_rows else np.eye(width), k, within)
    pieces = rotation.pieces(substrings or substrings_for(rotation.bits, rotation.radius, asking))
    prefixes = [min(n, PREFIX) for _, n in pieces]
    shared = Shared(spark, rotation)
    element = rows.schema["v"].dataType.elementType.simpleString()
    shape = f"piece int, at int, id long, code long, v array<{element}>"

    def expand(radius: int | None):
        def run(batches):
            rotation = shared.build(lambda r: r)
            for b in batches:
                for s in range(0, b.num_rows, 2_000):
                    b_ = b.slice(s, 2_000)
                    code = rotation.code(_unit(_matrix(b_.column(1), width)))
                    for i, ((low, size), p) in enumerate(zip(pieces, prefixes, strict=True)):
                        value = (code >> np.uint64(low)) & np.uint64((1 << size) - 1)
                        w, at = (np.arange(len(code)), (value >> np.uint64(size - p)).astype(np.int64)) if radius is None else blocks_within(value, size, p, radius // len(pieces))
                        for t in range(0, len(w), 20_000):
                            x = pa.array(w[t : t + 20_000])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(at[t : t + 20_000].astype(np.int32)), b_.column(0).take(x), pa.array(code.view(np.int64)).take(x), b_.column(1).take(x)], names=["piece", "at", "id", "code", "v"])

        return run

    index = rows.select("id", "v").mapInArrow(expand(None), shape)
    # a few hundred rows, one for each block of each substring: how many parts it is divided into
    parts = cut(index.groupBy("piece", "at").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")))
    index = index.join(F.broadcast(parts), ["piece", "at"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts").withColumn("asks", F.lit(0))

    def meet(radius: int):
        def run(batches):
            key, held, rows, found, size = None, [], None, [], 0
            for b in batches:
                names = [b.column(i).to_numpy() for i in (0, 1, 2, 3)]
                change = np.zeros(b.num_rows, bool)
                for c in names:
                    change[1:] |= c[1:] != c[:-1]
                edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
                for s, e in zip(edges, edges[1:], strict=False):
                    if s == e:
                        continue
                    now, asks, some = tuple(int(c[s]) for c in names[:3]), names[3][s], b.slice(s, e - s)
                    x = _scaled(_matrix(some.column(6), width))
                    group = (some.column(4).to_numpy(), some.column(5).to_numpy().view(np.uint64), x, _norm(x))
                    if not asks:
                        held = [*held, group] if now == key else [group]
                        key, rows = now, None
                        continue
                    if now != key:
                        continue
                    if rows is None:
                        rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                        held = [rows]
                    found.append(compare(rows, group, now[0], pieces, radius, k))
                    size += len(found[-1])
                    if size > HELD:
                        found = [best_of(np.concatenate(found), k)]
                        size = len(found[0])
                        if 2 * size > HELD:
                            yield batch_of(found[0])
                            found, size = [], 0
            if found:
                yield batch_of(best_of(np.concatenate(found), k))

        def batch_of(x):
            return pa.RecordBatch.from_arrays([pa.array(x["q"].copy()), pa.array(x["id"].copy()), pa.array(x["score"].copy())], names=["query_id", "vec_id", "score"])

        return run

    place = ["piece", "at", "part", "asks"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked, radius, done, wanted = rows.where("is_query").select("id", "v"), rotation.radius, None, min(k, total - 1)
    while True:
        probes = asked.mapInArrow(expand(radius), shape).join(F.broadcast(parts), ["piece", "at"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("asks", F.lit(1))
        both = index.unionByName(probes).select(*place, "id", "code", "v").repartition(*place[:3]).sortWithinPartitions(*place)
        met = both.mapInArrow(meet(radius), "query_id long, vec_id long, score double")
        met = store(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        full = met.where(F.col("rank") == wanted).select(F.col("query_id").alias("id"))
        asked = cut(asked.join(full, "id", "left_anti"))
        if radius >= rotation.bits or not wanted or asked.isEmpty():
            return met if done is None else done.union(met)
        told = met.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
        done = told if done is None else done.union(told)
        radius = min(rotation.bits, radius + max(4, (rotation.bits - radius) // 2))
