"""Substring dedup by content-defined chunking with a gear rolling hash.

A cut follows every byte where the top bits of the gear hash of the last 32 bytes are zero, except where the chunk would be too short; a
chunk that reaches the longest size is cut too. Cuts depend on the bytes around them alone, so an insertion moves only the chunks that it
touches. Of equal chunks (by 128-bit digest) the first in the order of documents stays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import slices
from .spans import cut_out, placed, removed, sha256, sorted_groups, starts_of

#: Mean distance of cut candidates is 2 ** BITS bytes; a chunk has LEAST to MOST bytes (a text's last one may have fewer).
BITS, LEAST, MOST = 5, 32, 512
#: Chunks below this size at the end of a text are never removed.
SHORTEST = 32
#: Chunks that a task gathers before it sends the first of each digest on.
GATHER = 400_000


def gear_table() -> np.ndarray:
    """256 32-bit values from a mixing rule over the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def cuts(text: bytes, gear: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text; the last one is its length. None for an empty text."""
    if not text:
        return []
    h = gear[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums of 2, 4, .. 32 shifted values
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, at, n = [], 0, len(text)
    for e in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while e - at > most:
            at += most
            out.append(at)
        if e - at >= least:
            at = e
            out.append(e)
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _firsts(a: np.ndarray, b: np.ndarray, d: np.ndarray, u: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by digest, then place; and which of the ordered rows stand at the first place of their digest (rows that repeat all do)."""
    order = np.lexsort((s, u, d, b, a))
    new = starts_of(a[order], b[order])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.ones(len(order), bool)
    for x in (d, u, s):
        first &= x[order] == x[order[lead]]
    return order, first


def repeated_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", gather: int = GATHER) -> DataFrame:
    """(d, u, start, size) of every chunk of which an earlier place holds a copy.

    A task keeps only the first of each digest among what it has gathered, so a chunk with any number of copies is sent once by each
    task. Copies that a task has settled itself go to the output through the same exchange, dealt by their place.
    """
    names = ["key", "a", "b", "d", "u", "s", "n"]  # n < 0: settled, a copy

    def settle(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b, d, u, s, n = rows
        order, first = _firsts(a, b, d, u, s)
        a, b, d, u, s, n = (x[order] for x in (a, b, d, u, s, n))
        spread = np.where(first, a, u ^ (s * 0x9E3779B97F4A7C1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, np.where(first, a, 0), np.where(first, b, 0), d, u, s, np.where(first, n, -n))], names=names)

    def emit(batches):
        gear, digest, parts, size = gear_table(), xxhash.xxh3_128_digest, [], 0
        for batch in slices(batches, 2):
            for d, u, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ends = cuts(t, gear)
                if ends and ends[-1] - (ends[-2] if len(ends) > 1 else 0) < SHORTEST:
                    ends.pop()
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                x = np.frombuffer(b"".join([digest(t[i:j]) for i, j in zip(starts, ends, strict=True)]), "<i8").reshape(-1, 2)
                s, e = np.array(starts), np.array(ends)
                parts.append((x[:, 0], x[:, 1], np.full(len(s), d), np.full(len(s), u), s, e - s))
                size += len(s)
                if size >= gather:
                    yield settle([np.concatenate(c) for c in zip(*parts, strict=True)])
                    parts, size = [], 0
        if parts:
            yield settle([np.concatenate(c) for c in zip(*parts, strict=True)])

    def decide(batches):
        for _, a, b, d, u, s, n in sorted_groups(batches, 3):
            first = np.ones(len(a), bool)
            open_ = np.flatnonzero(n > 0)
            order, lead = _firsts(a[open_], b[open_], d[open_], u[open_], s[open_])
            first[open_[order]] = lead
            copy = (n < 0) | ~first
            yield pa.RecordBatch.from_arrays([pa.array(x[copy]) for x in (d, u, s, np.abs(n))], names=["d", "u", "start", "size"])

    sent = placed(docs, text, key).mapInArrow(emit, "key long, a long, b long, d long, u long, s long, n long")
    return sent.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(decide, "d long, u long, start long, size long")


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (default: all) with kept_text (binary), n_bytes, n_removed and n_spans; one row for each row that goes in.

    Order is by id, then by a hash of the text, then by position; a null id comes last. Rows with equal id and text are one document to
    this operator: they get the same result. Null and empty texts have no bytes. A chunk that repeats inside one document goes too;
    a text's last chunk stays if it is under SHORTEST bytes. An id that isn't a number raises. A very long text has to fit a task, its chunks
    travel as rows. An empty frame gives an empty one; columns of any name are kept.
    """
    keep = list(docs.columns if keep is None else keep)

    def work(t, a, n):
        left, gone, runs = removed(t, a, n)
        return left, len(t), gone, runs

    return cut_out(docs, repeated_chunks(docs, text, key), text, key, keep, "kept_text binary, n_bytes long, n_removed long, n_spans long", work)


def digest_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""

    def work(t, a, n):
        left, gone, runs = removed(t, a, n)
        return len(t), gone, runs, sha256(left)

    return cut_out(docs, repeated_chunks(docs, text, key), text, key, [key], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)
