"""Exact substring dedup by sorting suffixes: bytes of a 50-byte string that also starts in an earlier document are removed.

Sorting every suffix would move many times the input, so the suffixes that can have a partner are found first. Each 50-byte window has a
minimizer: the place of the 20-byte string in it with the smallest hash, the leftmost of equals. Equal windows have equal minimizers at
equal distances. Windows whose minimizer string occurs in one document only have no partner; the others go on. Whole copies of an earlier
text are known beforehand: all of their bytes go, and what only copies of one text hold needs no partner either.

Neighbouring windows share a minimizer and travel as one string of 50 to 80 bytes. Spark's sampled splitters deal these strings out by the
leading bytes of the minimizer string, then by document, so that a hot string spreads over several buckets. In a bucket all windows are
suffixes to sort: multikey quicksort, eight bytes at a time, with the first member of a tie as pivot. Windows whose minimizer begins
like the first or last one of a bucket may have equals in the next bucket; those are compared across boundaries by a second exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, store
from .spans import cut_out, placed, removed, sha256, sorted_groups, starts_of

LENGTH, GRAM = 50, 20
#: Bytes of text that are hashed at a time; minimizers, and strings, that a task gathers before it sends them; strings sorted at a time.
CHUNK, GATHER, STRINGS, SORTED = 1 << 20, 1_500_000, 200_000, 40_000
_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)
_LOW, _TOP16 = np.uint64(0xFFFFFFFF), np.uint64(0xFFFF << 48)
_SIGN = np.uint64(1 << 63)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` bytes, put together from runs of powers of two."""
    with np.errstate(over="ignore"):
        level, width, power, out, done = data.astype(np.uint64) * _C + np.uint64(1), 1, _B, None, 0
        while size:
            if size & 1:
                if out is None:
                    out, done = level, width
                else:
                    n = len(data) - done - width + 1
                    out, done = out[:n] * power + level[done : done + n], done + width
            size >>= 1
            if size:
                n = len(level) - width
                level, power, width = level[:n] * power + level[width : width + n], power * power, 2 * width
        out = (out ^ (out >> np.uint64(32))) * _C
        return out ^ (out >> np.uint64(29))


def minimizers(texts: Sequence[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash, first, offset, count) of each run of windows with one minimizer: its hash, the run's first window, the minimizer's
    distance from there, and the number of windows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < length or sizes.max() < length:
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    n = len(data) - length + 1
    low = np.minimum(low[:n], low[span - width : span - width + n])
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    place = (low[window] & _LOW).astype(np.int64)
    new = np.flatnonzero(starts_of(place))
    first, at, own = window[new], place[new], owner[new]
    return own, h[at], first - starts[own], at - first, np.diff(np.append(new, len(place)))


def _chunks(texts: Sequence[bytes]):
    """Slices of texts of about CHUNK bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _pack(first: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first << 12) | (offset << 6) | count


def whole_copies(rows: DataFrame) -> DataFrame | None:
    """(d, u, start, size) of rows (d, u, t) whose text is that of a smaller d and holds a window; None should two texts share a hash u."""
    heads = cut(rows.select("d", "u", F.octet_length("t").cast("long").alias("size"), F.unhex(F.sha2("t", 256)).alias("h")).distinct())
    least = heads.groupBy("u").agg(F.min("d").alias("least"), F.max("d").alias("last"), F.min("h").alias("a"), F.max("h").alias("b"))
    several = cut(least.where("least < last or a <> b"))
    if not several.where("a <> b").isEmpty():
        return None
    later = heads.join(several, "u").where((F.col("d") > F.col("least")) & (F.col("size") >= LENGTH))
    return cut(later.select("d", "u", F.lit(0).cast("long").alias("start"), "size"))


def candidates(rows: DataFrame, by_text: bool = False) -> DataFrame:
    """(d, u, p): packed runs of windows of rows (d, u, t) whose minimizer string has the hash of one in a document with another d and, with
    ``by_text``, another u; by u too, so that rows with one d, null ids above all, don't gather each other's windows.

    What a task knows to be shared among its own documents needs no partner elsewhere: of these only one row for each string is dealt by
    the string's hash, so a hot string never gathers more rows than there are such lots. Kinds: 0 asks, 1 knows and tells, 2 knows.
    """

    def differ(at, *ids):
        """Of groups that begin at ``at``: do their rows differ in each id? Then two rows do in all of them."""
        return np.logical_and.reduce([np.minimum.reduceat(x, at) != np.maximum.reduceat(x, at) for x in ids[: 1 + by_text]])

    def settle(parts):
        h, d, u, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, d, u, p = h[order], d[order], u[order], p[order]
        new = starts_of(h)
        at = np.flatnonzero(new)
        shared = np.repeat(differ(at, d, u), np.diff(np.append(at, len(h))))
        kind = np.where(shared, np.where(new, 1, 2), 0)
        with np.errstate(over="ignore"):
            key = np.where(kind == 2, ((d ^ u).astype(np.uint64) * _B ^ p.astype(np.uint64)) * _C & ~_LOW, h)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(d), pa.array(u), pa.array(p << 2 | kind)], names=["key", "d", "u", "p"])

    def emit(batches):
        parts, size = [], 0
        for batch in slices(batches, 2):
            d, u, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for s in _chunks(texts):
                own, h, first, offset, count = minimizers(texts[s])
                if len(own):
                    parts.append((h, d[s][own], u[s][own], _pack(first, offset, count)))
                    size += len(own)
                if size >= GATHER:
                    yield settle(parts)
                    parts, size = [], 0
        if parts:
            yield settle(parts)

    def decide(batches):
        for key, d, u, p in sorted_groups(batches, 1):
            kind = p & 3
            open_ = np.flatnonzero(kind < 2)
            good = kind == 2
            if len(open_):
                new = np.flatnonzero(starts_of(key[open_]))
                shared = differ(new, d[open_], u[open_]) | (np.maximum.reduceat(kind[open_], new) == 1)
                good[open_] = np.repeat(shared, np.diff(np.append(new, len(open_))))
            yield pa.RecordBatch.from_arrays([pa.array(d[good]), pa.array(u[good]), pa.array(p[good] >> 2)], names=["d", "u", "p"])

    sent = rows.select("d", "u", "t").mapInArrow(emit, "key long, d long, u long, p long")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(decide, "d long, u long, p long")


def _strings(batches):
    """(lead, d, u, first, shape, string) of each candidate run of rows (d, u, t, p).

    Of equal strings in a task's lot only those of the smallest d are dealt; the others' windows all have an earlier copy, and they go on
    without a string.
    """

    def settle(parts):
        lead, d, u, first, shape = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
        strings = [s for x in parts for s in x[5]]
        h = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        order = np.lexsort((d, shape, h))
        group = np.flatnonzero(starts_of(h[order], shape[order]))
        rank = np.repeat(group, np.diff(np.append(group, len(order))))
        lead_of = order[rank]  # the first of the same hash and shape
        settled = np.zeros(len(d), bool)
        later = d[order] > d[lead_of]
        settled[order[later]] = [strings[i] == strings[j] for i, j in zip(order[later].tolist(), lead_of[later].tolist(), strict=True)]
        with np.errstate(over="ignore"):
            spread = ((u.astype(np.uint64) ^ first.astype(np.uint64)) * _B & _TOP16).view(np.int64)  # zeros travel for nothing
        blobs = pa.array([None if s else x for s, x in zip(settled.tolist(), strings, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.where(settled, spread, lead)), pa.array(d), pa.array(u), pa.array(first), pa.array(shape), blobs], names=["lead", "d", "u", "first", "shape", "string"])

    parts, size = [], 0
    for batch in slices(batches, 2):
        d, u, texts, lists = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            p = lists[i].values
            if p is None or not len(p):
                continue
            t, p = texts[i].as_py(), p.to_numpy()
            first, offset, count = p >> 12, (p >> 6) & 63, p & 63
            fits = first + LENGTH + count - 1 <= len(t)
            first, offset, count = first[fits], offset[fits], count[fits]
            if not len(first):
                continue
            word = np.ndarray(len(t) - 7, ">u8", t, strides=(1,))[first + offset].astype(np.uint64)
            n = len(first)
            parts.append(((word ^ _SIGN).view(np.int64), np.full(n, d[i].as_py()), np.full(n, u[i].as_py()), first, offset << 6 | count, [t[a:e] for a, e in zip(first.tolist(), (first + LENGTH + count - 1).tolist(), strict=True)]))
            size += n
            if size >= STRINGS:
                yield settle(parts)
                parts, size = [], 0
    if parts:
        yield settle(parts)


def equal_suffixes(data: bytes, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at ``starts``, up to ``length`` bytes: those that tie with others, in order, and the number of
    their tie. A tie whose members all equal its pivot in the next eight bytes stays as it is; only others are sorted further."""
    words = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    depths = [*range(0, length - 7, 8), length - 8]
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in dict.fromkeys(depths):
        if not len(order):
            break
        v = words[starts[order] + depth].astype(np.uint64)
        new = starts_of(group)
        at = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        uneven = np.bincount(number, v != v[at][number], len(at)) > 0
        moving = np.flatnonzero(uneven[number])
        if len(moving):
            by = np.argsort(v[moving], kind="stable") if len(at) == 1 else np.lexsort((v[moving], number[moving]))
            order[moving], v[moving] = order[moving][by], v[moving][by]
        new = starts_of(number, v)
        size = np.diff(np.append(np.flatnonzero(new), len(v)))
        number = np.cumsum(new) - 1
        tied = size[number] > 1
        order, group = order[tied], number[tied]
    return order, group


def _sort_bucket(batches):
    """(d, u, start, size, window): spans of windows with a copy in an earlier document; windows that a neighbouring bucket must decide on."""
    names = ["d", "u", "start", "size", "window"]

    def batch_of(d, u, start, size, window=None):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(u), pa.array(start), pa.array(size), pa.nulls(len(d), pa.binary()) if window is None else pa.array(window, pa.binary())], names=names)

    def expand(d, u, first, shape, strings):
        count = (shape & 63).astype(np.int64)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        row = np.repeat(np.arange(len(strings)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return b"".join(strings), (np.cumsum(sizes) - sizes)[row] + j, row, j

    def work(d, u, first, shape, strings, edge=False):
        """Spans that are settled here. At an edge of the bucket, of equal windows those in the first document are left to be decided."""
        if not len(strings):
            return
        data, at, row, j = expand(d, u, first, shape, strings)
        order, group = equal_suffixes(data, at)
        hit = order
        if len(order):
            new = np.flatnonzero(starts_of(group))
            dd = d[row[order]]
            least = np.repeat(np.minimum.reduceat(dd, new), np.diff(np.append(new, len(dd))))
            hit = np.sort(order[dd > least])
        if edge:
            open_ = np.ones(len(row), bool)
            open_[hit] = False
            for s in range(0, len(row), 50_000):
                k = s + np.flatnonzero(open_[s : s + 50_000])
                r = row[k]
                yield batch_of(d[r], u[r], first[r] + j[k], np.full(len(k), LENGTH), [data[a : a + LENGTH] for a in at[k].tolist()])
        if not len(hit):
            return
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]))
        r, n = row[hit[new]], np.diff(np.append(new, len(hit)))
        yield batch_of(d[r], u[r], first[r] + j[hit[new]], n + LENGTH - 1)

    held, first_lead = [], None
    for batch in batches:
        settled = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        lead, d, u, first, shape = (batch.column(i).to_numpy() for i in range(5))
        if settled.any():
            yield batch_of(d[settled], u[settled], first[settled], (shape[settled] & 63).astype(np.int64) + LENGTH - 1)
        if settled.all():
            continue
        strings = [s for s in batch.column(5).to_pylist() if s is not None]
        now = [x[~settled] for x in (lead, d, u, first, shape)]
        held.append((*now, strings))
        if first_lead is None:
            first_lead = now[0][0]
        if sum(len(x[0]) for x in held) < SORTED:
            continue
        rows = [np.concatenate(x) for x in list(zip(*held, strict=True))[:5]]
        strings = [s for x in held for s in x[5]]
        a, e = np.searchsorted(rows[0], first_lead, "right"), np.searchsorted(rows[0], rows[0][-1])
        yield from work(*(x[:a] for x in rows[1:]), strings[:a], edge=True)
        yield from work(*(x[a:e] for x in rows[1:]), strings[a:e])
        e = max(a, e)
        held = [(*(x[e:] for x in rows), strings[e:])] if e < len(strings) else []
    if held and (n := sum(len(x[0]) for x in held)):
        rows = [np.concatenate(x) for x in list(zip(*held, strict=True))[:5]]
        strings = [s for x in held for s in x[5]]
        a, e = np.searchsorted(rows[0], first_lead, "right"), np.searchsorted(rows[0], rows[0][-1])
        e = max(a, e)
        yield from work(*(x[a:e] for x in rows[1:]), strings[a:e])
        for c in (slice(0, a), slice(e, n)):
            yield from work(*(x[c] for x in rows[1:]), strings[c], edge=True)


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(d, u, start, size): byte spans made of 50-byte windows that also start in a document with a smaller d."""
    rows = placed(docs, text, key)
    copies = whole_copies(rows)
    found = store(candidates(rows, copies is not None))
    lists = found.groupBy("d", "u").agg(F.collect_set("p").alias("p"))  # repeated rows tell their windows once
    if copies is not None:
        lists = lists.join(copies, ["d", "u"], "left_anti")
    strings = rows.join(lists, ["d", "u"]).select("d", "u", "t", "p").mapInArrow(_strings, "lead long, d long, u long, first long, shape long, string binary")
    sorted_ = strings.repartitionByRange("lead", "d").sortWithinPartitions("lead", "d").mapInArrow(_sort_bucket, "d long, u long, start long, size long, window binary")
    spans = store(sorted_)
    open_ = spans.where(F.col("window").isNotNull())
    least = cut(open_.groupBy("window").agg(F.min("d").alias("least")))  # stored, so that a hot window can be split in the join
    across = open_.join(least, "window").where("d > least").select("d", "u", "start", "size")
    settled = spans.where(F.col("window").isNull()).select("d", "u", "start", "size").union(across)
    return settled if copies is None else settled.union(copies)


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (default: all) with kept_text (binary), n_bytes, n_removed and n_spans; one row for each row that goes in.

    Strings are judged on the input. Null and empty texts have no bytes. A null id counts as larger than any other; rows with one id
    never lose anything to each other, and an id that isn't a number raises. Texts are hashed in slices of a few MB; a very long one has to
    fit a task, its windows travel as many short strings. An empty frame gives an empty one; columns of any name are kept.
    """
    keep = list(docs.columns if keep is None else keep)

    def work(t, a, n):
        left, gone, runs = removed(t, a, n)
        return left, len(t), gone, runs

    return cut_out(docs, repeated_spans(docs, text, key), text, key, keep, "kept_text binary, n_bytes long, n_removed long, n_spans long", work)


def digest_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row."""

    def work(t, a, n):
        left, gone, runs = removed(t, a, n)
        return len(t), gone, runs, sha256(left)

    return cut_out(docs, repeated_spans(docs, text, key), text, key, [key], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)
