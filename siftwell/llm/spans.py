"""Byte spans of texts: found in tasks, matched through one exchange, cut out of the texts at the end."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, slices

#: A document's place in the order of documents: its id (null: after all others), then a hash of its text for ids that repeat.
LAST = 2**63 - 1


def placed(docs: DataFrame, text: str, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(d, u, t, ...kept columns): order of the document, its UTF-8 bytes (null: none), and columns to carry along."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(col(key).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(t).alias("u"), t.cast("binary").alias("t"), *map(col, keep))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by their first ``keys`` columns; a group of equal keys is never split between two yields."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        last = np.zeros(len(now[0]), bool)
        for c in now[:keys]:
            last |= c != c[-1]
        end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        rest = [c[end:] for c in now]
        if end:
            yield [c[:end] for c in now]
    if rest is not None and len(rest[0]):
        yield rest


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """True where a new group of equal keys begins, for arrays that are sorted by them."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        same = np.ones(len(new) - 1, bool)
        for k in keys:
            same &= k[1:] == k[:-1]
        new[1:] = ~same
    return new


def cut_out(docs: DataFrame, spans: DataFrame, text: str, key: str, keep: Sequence[str], fields: str, work: Callable[[bytes, np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """docs' columns ``keep`` and the columns ``fields`` (a DDL list) that work(bytes, starts, lengths) returns for each row.

    ``spans`` (d, u, start, size) are gathered by document, each once however many copies of the row told it, so a group is never larger
    than a document's own spans, and joined to the texts in one exchange. Names of kept columns may be anything: they travel under numbers.
    """
    base = placed(docs, text, key, keep).toDF("d", "u", "t", *(f"k{i}" for i in range(len(keep))))
    lists = spans.groupBy("d", "u").agg(F.collect_set(F.struct("start", "size")).alias("s"))
    joined = base.join(lists, ["d", "u"], "left").select(*(f"k{i}" for i in range(len(keep))), "t", F.col("s.start").alias("a"), F.col("s.size").alias("n"))
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join([*(f"k{i} {docs.select(col(c)).schema[0].dataType.simpleString()}" for i, c in enumerate(keep)), fields])

    def run(batches):
        none = np.empty(0, np.int64)
        for b in slices(batches, len(keep)):
            at = len(keep)
            texts, a, n = b.column(at).to_pylist(), b.column(at + 1), b.column(at + 2)
            rows = [work(t, none if (x := a[i].values) is None else x.to_numpy(zero_copy_only=False).astype(np.int64), none if (y := n[i].values) is None else y.to_numpy(zero_copy_only=False).astype(np.int64)) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array([r[j] for r in rows]) for j in range(len(names)))], names=[*(f"k{i}" for i in range(at)), *names])

    return joined.mapInArrow(run, schema).toDF(*keep, *(free_name(keep, n) for n in names))


def merged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint [start, end) spans that cover the same positions; spans that touch become one."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    a, e = starts[order], np.maximum.accumulate((starts + sizes)[order])
    new = np.concatenate([[True], a[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return a[at], e[np.concatenate([at[1:] - 1, [len(a) - 1]])]


def removed(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of text, how many bytes went, and in how many maximal runs."""
    a, e = merged(starts, sizes)
    if not len(a):
        return text, 0, 0
    parts, at = [], 0
    for x, y in zip(a.tolist(), e.tolist(), strict=True):
        parts.append(text[at:x])
        at = y
    return b"".join([*parts, text[at:]]), int((e - a).sum()), len(a)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
