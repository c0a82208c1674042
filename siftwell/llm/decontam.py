"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words, the alphabet is the set of words. For every block of two consecutive words the shift table
tells how far the search may jump without missing an occurrence; a block that ends a pattern selects a bucket of patterns, which are
told apart by their first block and then compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, annotate, col, cut, free_name

WINDOW = 13
#: Windows (about 1 KB each in a task) that one pass over the documents searches for; a larger benchmark takes several passes. Windows
#: of a piece of an item; longer items are cut, so that passes can be of equal size.
PASS_WINDOWS, PIECE = 400_000, 2_000

#: Words are runs of digits, letters and all bytes beyond ASCII; A-Z become a-z and every other byte a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for null."""
    return text.translate(_LETTERS).split() if text else []


def windows(text: bytes | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text that has words is one window itself."""
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class WuManber:
    """Search for many patterns of one length."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, length), length - end)
            self.buckets[p[-self.block :]][p[: self.block]].append(p)

    def search(self, w: Sequence[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        found, m, step = [], self.length, self.length - self.block + 1
        at, n, shift, buckets, block = m - 1, len(w), self.shift, self.buckets, self.block
        while at < n:
            b = (w[at - 1], w[at]) if block == 2 else (w[at],)
            jump = shift.get(b, step)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for p in buckets[b].get(tuple(w[start : start + block]), ()):
                if p == tuple(w[start : at + 1]):
                    found.append((start, p))
            at += 1
        return found


class Matcher:
    """All windows of some benchmark items: one search for each length of window."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], size: int = WINDOW):
        self.owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            for p in windows(text, size):
                self.owners[p].add(item)
        lengths = defaultdict(list)
        for p in self.owners:
            lengths[len(p)].append(p)
        self.searches = [WuManber(ps, n) for n, ps in sorted(lengths.items())]

    def match(self, text: bytes | None) -> dict:
        """Number of words, disjoint word spans inside occurrences, and the items that occur."""
        w = words(text)
        hits = [(s, s + len(p), p) for search in self.searches for s, p in search.search(w)]
        items = set().union(*(self.owners[p] for p in {p for _, _, p in hits})) - {None}
        spans: list[dict] = []
        for s, e, _ in sorted(hits):
            if spans and s <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], e)
            else:
                spans.append({"start": s, "end": e})
        return {"n_words": len(w), "spans": spans, "item_ids": sorted(items)}


def _pieces(batches, size: int):
    """(item, words, number of windows) of rows (item, text): an item of many windows as several pieces, each window in one of them."""
    for batch in batches:
        out = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words(t)
            n = max(1, len(w) - size + 1) if w else 0
            out += [(i, b" ".join(w[at : at + PIECE + size - 1]), min(PIECE, n - at)) for at in range(0, n, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], names=["i", "t", "n"])


def _search(docs: DataFrame, text: str, name: str, items: list, size: int, keep: Sequence[str]) -> DataFrame:
    shared = Shared(docs.sparkSession, items)

    def build():
        matcher = shared.build(lambda items: Matcher(items, size))
        return lambda raw: pa.array([matcher.match(t) for t in raw.to_pylist()], _ARROW)

    return annotate(docs, text, T.StructField(name, RESULT), build, keep)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", result: str | None = None, size: int = WINDOW, keep: Sequence[str] | None = None, pass_windows: int = PASS_WINDOWS) -> tuple[DataFrame, str]:
    """docs with a struct column: n_words, spans of word positions inside any occurrence of a benchmark window, ids of the items that occur.

    Returns the frame and the struct's name: ``result``, or a free name like ``contamination``. One row comes out for each row
    that goes in, repeated rows and nulls included. A null or wordless document has no words; a null or wordless item has no window;
    windows of an item without id mark words but name no item; an empty benchmark marks nothing.

    The benchmark is cut by a hash into passes of about ``pass_windows``; that measured number bounds what is collected and broadcast. A
    very long item is cut into pieces that share no window, a very long document is searched whole. With one pass the documents are read once and nothing is shuffled. With more, passes search all distinct texts and their findings
    are joined by the text's digest.
    """
    keep = list(docs.columns if keep is None else keep)
    name = free_name([*docs.columns], result or "contamination")
    items = benchmark.select(col(item).cast("string").alias("i"), col(item_text).cast("string").cast("binary").alias("t")).where(F.col("t").isNotNull())
    pieces = cut(items.mapInArrow(lambda b: _pieces(b, size), "i string, t binary, n long").distinct())
    passes = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // pass_windows))
    part = lambda k: [(r.i, bytes(r.t)) for r in pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).toLocalIterator()]
    if passes == 1:
        return _search(docs, text, name, part(0), size, keep), name
    texts = docs.select(col(text).alias("t")).where(F.col("t").isNotNull())
    found = None
    for k in range(passes):
        hits = _search(texts.withColumn("k", F.sha2("t", 256)), "t", "r", part(k), size, ["k"]).where(F.size("r.spans") > 0).distinct()
        hits = cut(hits)
        found = hits if found is None else found.union(hits)
    one = found.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("r.spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.item_ids")))).alias("ids"))
    merged = F.expr("""aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
        case when size(a) > 0 and x.start <= a[size(a) - 1].end
             then concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end))))
             else concat(a, array(x)) end)""")
    key, spans, ids = (free_name([*docs.columns, name], n) for n in ("text_key", "text_spans", "text_ids"))
    counted = _search(docs.withColumn(key, F.sha2(col(text), 256)), text, name, [], size, [*keep, key])
    joined = counted.join(one.select(F.col("k").alias(key), merged.alias(spans), F.col("ids").alias(ids)), key, "left")
    value = F.struct(col(name)["n_words"].alias("n_words"), F.coalesce(col(spans), col(name)["spans"]).alias("spans"), F.coalesce(col(ids), col(name)["item_ids"]).alias("item_ids"))
    return joined.select(*map(col, keep), value.alias(name)), name


def hit_words(result: str):
    """Number of words inside the spans."""
    return F.aggregate(col(result)["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(result: str):
    """The rule: at least one word is hit, and hits are at least one word in twenty."""
    return (hit_words(result) > 0) & (20 * hit_words(result) >= col(result)["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rule doesn't call contaminated, with their own columns."""
    marked, name = find_contamination(docs, benchmark, text)
    return marked.where(~is_contaminated(name)).drop(name)
