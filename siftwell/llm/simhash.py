"""Near-duplicates by SimHash fingerprints, with Golay-code fuzzy hashing to find fingerprints that differ in few bits.

The binary Golay code (23, 12) puts every 23-bit word within three bits of exactly one codeword. A fingerprint is cut into segments of
22, 21 and 21 bits. A segment's keys are the codewords nearest to it and to all words one bit away (one to six); if two segments differ in
at most two bits, a word between them is at most one bit from either, so they share a key. With at most two differing bits over three
segments, some segment agrees exactly while the next one (cyclically) differs in at most two bits. So a bucket is named by one exact segment
and a key of the next; all that link meet in a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, col, cut, free_name, join_skewed
from .components import connected_components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, bits
#: Buckets of more fingerprints than this are not worked on by one task.
BUCKET = 2048
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011

#: A-Z become a-z; the six blanks of ASCII become a space.
_BLANKS = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes | None, size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words joined by a space, repeats included; of fewer words the whole sequence; none without words."""
    w = text.translate(_BLANKS).split(b" ") if text else []
    w = [x for x in w if x]
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def fingerprint_rows(texts: Sequence[bytes | None], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if it is set in over half of the shingles' hashes."""
    out, digest = np.zeros(len(texts), np.uint64), xxhash.xxh64_intdigest
    for k, t in enumerate(texts):
        s = shingles(t, size)
        if not s:
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(s), 1 << 16):
            h = np.array([digest(x, seed) for x in s[at : at + (1 << 16)]], ">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(s)).view(">u8")[0]
    return out


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SHINGLE, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with the fingerprint of the text as a signed long; null and blank texts have 0. No shuffle."""
    build = lambda: lambda raw: pa.array(fingerprint_rows(raw.to_pylist(), size).view(np.int64))
    return annotate(docs, text, T.StructField(name, T.LongType()), build, keep)


@lru_cache(1)
def golay_errors() -> np.ndarray:
    """Syndrome -> the error of at most three bits that has it."""
    bits = [1 << i for i in range(23)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    out = np.zeros(1 << 11, np.int64)
    e = np.array(errors, np.int64)
    out[golay_syndrome(e)] = e
    return out


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    r = words.copy()
    for i in range(22, 10, -1):
        r ^= ((r >> i) & 1) * (GENERATOR << (i - 11))
    return r


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """Syndromes are linear: those of the low 12 and of the high 11 bits add up."""
    low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
    return golay_syndrome(low), golay_syndrome(high)


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each 23-bit word."""
    low, high = _syndromes()
    return (words ^ golay_errors()[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in ``fps`` and bucket of every bucket that a fingerprint belongs to."""
    who, keys = [], []
    flips = np.concatenate([[0], 1 << np.arange(23)])
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for i in range(3):
        near = np.sort(golay_index(seg[(i + 1) % 3][:, None] ^ flips), axis=1)
        fresh = np.concatenate([np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, at = np.nonzero(fresh)
        who.append(row)
        keys.append((np.int64(i) << 36) | (near[row, at] << 22) | seg[i][row])
    return np.concatenate(who), np.concatenate(keys)


def links_within(fps: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect everything in a bucket which links at MOST_BITS or fewer: for each fingerprint compared with all that come
    before it, one link into every group met so far, so never more links than fingerprints."""
    root = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= MOST_BITS)
        if not len(near):
            continue
        groups, first = np.unique(root[near], return_index=True)
        out += [(int(fps[i]), int(fps[near[k]])) for k in first]
        root[i] = groups[0]
        for g in groups[1:]:
            root[: i + 1][root[: i + 1] == g] = groups[0]
    return out


def _bucket_links(batches):
    """Links inside the buckets of rows (key, fp) that are sorted by key; a bucket may go on in the next batch."""
    rest = np.empty((0, 2), np.int64)
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(rows: np.ndarray) -> pa.RecordBatch:
        links = []
        edges = np.flatnonzero(np.diff(rows[:, 0])) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(rows)]]))
        starts = np.concatenate([[0], edges])[sizes > 1]
        two = starts[sizes[sizes > 1] == 2]
        a, b = rows[two, 1], rows[two + 1, 1]
        good = np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS
        for s, n in zip(starts.tolist(), sizes[sizes > 1].tolist(), strict=True):
            if n > 2:
                links += links_within(rows[s : s + n, 1].view(np.uint64))
        links = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[good], links[:, 0]])), pa.array(np.concatenate([b[good], links[:, 1]]))], schema=shape)

    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
        if len(rows):
            last = np.searchsorted(rows[:, 0], rows[-1, 0])
            rest = rows[last:]
            yield work(rows[:last])
    yield work(rest)


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of all pairs at MOST_BITS or fewer bits."""

    def explode(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                who, keys = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[who])], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(explode, "key long, fp long")
    large = cut(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    if large.isEmpty():
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links, "a long, b long").distinct()
    small = keyed.join(large, "key", "left_anti")
    links = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links, "a long, b long")
    # In large buckets fingerprints meet at the words between them: all that are one bit or less from a word are two or fewer apart.
    crowd = keyed.join(large, "key", "left_semi").select("fp").distinct()
    between = crowd.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    met = between.withColumn("b", F.min("fp").over(Window.partitionBy("word")))  # a word has 65 neighbours at most
    return links.union(met.where("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: component_id is the smallest id among all documents that links lead to.

    Equal fingerprints link too, so null and blank texts (fingerprint 0) form one component. A null id keeps its row and never is the
    smallest; a component of null ids alone has a null component_id. Repeated rows come out as often as they go in. Work on links is on
    distinct fingerprints; copies are only counted and joined back, the commonest fingerprints by broadcast. An id that isn't a number
    raises. A very long text is read whole, by 65,536 shingles at a time, and has to fit a task. An empty frame gives an empty one.
    """
    prints = cut(add_fingerprint(docs, text, "_fp", size, [key]).select(col(key).cast("long").alias("id"), F.col("_fp").alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(distinct, bucket))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(placed.join(named, "root").select("fp", "component_id"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    joined = join_skewed(prints, by_print, "fp", distinct, total)
    return joined.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with the smallest id of each component. Rows that repeat that id stay as they are; so do rows without id."""
    name = free_name(docs.columns, "gone")
    gone = near_duplicates(docs, text, key).where(col(key) != F.col("component_id")).select(col(key).alias(name)).distinct()
    return docs.join(gone, col(key).cast("long") == F.col(name), "left_anti")
