"""64-bit SimHash of words and CJK runs, Hamming distance, bands, and title similarity."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

_CJK, _OTHER = re.compile("[一-鿿]+"), re.compile(r"[^a-zA-Z0-9\s]")
_TITLE_WORD = re.compile(r"[一-鿿\w]+")
_STOP = frozenset(V.TITLE_STOPWORDS)
BANDS, BAND_BITS = 4, 16
#: Fingerprints of a side from which looking up neighbours of each word pays against comparing all with all.
MANY = 100_000
#: Pairs that are expanded at once.
AT_ONCE = 2_000_000


def features(text: str) -> list[str]:
    """Triples of neighbouring ideographs (a shorter run as it is), and pairs of neighbouring Latin words (a single word as it is)."""
    runs = _CJK.findall(text)
    out = [f"zh_{r[i : i + 3]}" for r in runs for i in range(max(1, len(r) - 2))]
    words = _OTHER.sub(" ", text).lower().split()
    return out + ([f"en_{a}_{b}" for a, b in zip(words, words[1:], strict=False)] or [f"en_{w}" for w in words])


def simhash_of(text: str | None) -> int:
    """Signed 64 bits: a bit is set if it is set in over half of the features' hashes (top 64 bits of MD5)."""
    found = features(text) if text else []
    if not found:
        return 0
    h = np.frombuffer(b"".join(hashlib.md5(f.encode(), usedforsecurity=False).digest()[:8] for f in found), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """simhash_of over Arrow batches; as 64 conditional sums over exploded features it takes many times as long in SQL."""
    for s in batches:
        yield s.map(simhash_of).astype("int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masks(most: int) -> np.ndarray:
    """All words of a band's size with at most ``most`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(BAND_BITS), k)], np.int64)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(x for x, _ in parts)]), np.concatenate([none, *(y for _, y in parts)])


def _expanded(row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for every place from begin to begin + size of each row, in pieces."""
    row, begin, size = (x[size > 0] for x in (row, begin, size))
    ends = np.cumsum(size)
    cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] + AT_ONCE, AT_ONCE)) if len(ends) else []
    at = 0
    for to in np.minimum(np.asarray(cuts, np.int64) + 1, len(row)):
        r, b, n = row[at:to], begin[at:to], size[at:to]
        if len(r):
            yield np.repeat(r, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b, n)
        at = to


def _close_by_scan(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All with all, in pieces that stay in a core's cache."""
    for i in range(0, len(a), 16):
        for j in range(0, len(b), 4096):
            hit = np.flatnonzero(np.bitwise_count(a[i : i + 16, None] ^ b[None, j : j + 4096]) <= most)
            if len(hit):
                width = len(b[j : j + 4096])
                yield hit // width + i, hit % width + j


def _close_by_words(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By the words of each band: one of four bands differs in at most a quarter of the bits. A pair counts in the first band that does."""
    radius = most // BANDS
    near, low = masks(radius), np.uint64((1 << BAND_BITS) - 1)
    for band in range(BANDS):
        shift = np.uint64(BAND_BITS * band)
        wa, wb = (((x >> shift) & low).astype(np.int64) for x in (a, b))
        order = np.argsort(wb, kind="stable")
        start = np.searchsorted(wb[order], np.arange((1 << BAND_BITS) + 1))

        def good(i: np.ndarray, j: np.ndarray, band: int = band) -> tuple[np.ndarray, np.ndarray]:
            x = a[i] ^ b[j]
            hit = np.bitwise_count(x) <= most
            i, j, x = i[hit], j[hit], x[hit]
            first = np.ones(len(x), bool)
            for before in range(band):
                first &= np.bitwise_count((x >> np.uint64(BAND_BITS * before)) & low) > radius
            return i[first], j[first]

        if radius < 2:
            for mask in near:
                w = wa ^ mask
                for i, at in _expanded(np.arange(len(a)), start[w], start[w + 1] - start[w]):
                    yield good(i, order[at])
        else:
            rows = np.argsort(wa, kind="stable")
            words, begin = np.unique(wa[rows], return_index=True)
            ordered = b[order]
            for word, mine in zip(words, np.split(rows, begin[1:]), strict=True):
                w = near ^ word
                size = start[w + 1] - start[w]
                at = np.arange(size.sum()) + np.repeat(start[w] + size - np.cumsum(size), size)
                other = ordered[at]
                step = max(1, AT_ONCE // max(1, len(other)))
                for k in range(0, len(mine), step):
                    hit = np.flatnonzero(np.bitwise_count(a[mine[k : k + step], None] ^ other) <= most)
                    if len(hit):
                        yield good(mine[k + hit // len(other)], order[at[hit % len(other)]])


def close_places(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all a[i] and b[j] (64 bits, unsigned) that differ in at most ``most`` bits."""
    words = min(len(a), len(b)) > (MANY if most // BANDS > 1 else 500)
    return _joined(list((_close_by_words if words else _close_by_scan)(a, b, most)))


def close_in_groups(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As close_places, of rows of equal groups only. Small groups are compared together, a large one by itself."""
    rows, others = np.argsort(ga, kind="stable"), np.argsort(gb, kind="stable")
    groups, begin, size = np.unique(ga[rows], return_index=True, return_counts=True)
    first, last = np.searchsorted(gb[others], groups), np.searchsorted(gb[others], groups, "right")
    large, found = size * (last - first) > 10_000, []
    for k in np.flatnonzero(large):
        i, j = close_places(a[rows[begin[k] : begin[k] + size[k]]], b[others[first[k] : last[k]]], most)
        found.append((rows[begin[k] + i], others[first[k] + j]))
    of = np.repeat(np.arange(len(groups)), size)
    small = np.flatnonzero(~large[of])
    for i, at in _expanded(rows[small], first[of[small]], (last - first)[of[small]]):
        j = others[at]
        hit = np.bitwise_count(a[i] ^ b[j]) <= most
        found.append((i[hit], j[hit]))
    return _joined(found)


def preview(text: Column) -> Column:
    """The part of a text that its fingerprint is made of: characters 200 to 1000, of a short text the first 800."""
    return F.when(F.length(text) > 200, F.substring(text, 201, 800)).otherwise(F.substring(text, 1, 800))


def title_words(title: Column) -> Column:
    """Distinct words without stop words."""
    found = F.regexp_extract_all(title, F.lit("(?U)[一-鿿\\w]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*V.TITLE_STOPWORDS)))


def title_similarity_of(a: str | None, b: str | None) -> float:
    """0.6 of the Jaccard similarity of words and 0.4 of the ratio of matching characters; 0 if a side has no words."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = ({w for w in _TITLE_WORD.findall(t) if w not in _STOP} for t in (a, b))
    if not x or not y:
        return 0.0
    return 0.6 * len(x & y) / len(x | y) + 0.4 * difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
