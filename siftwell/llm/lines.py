"""Line dedup by a suffix array over sequences of line ids, built by distributed prefix doubling.

Every line is the beginning of a suffix: the lines from there to its document's end. Round k gives each suffix the rank of its first
2 ** k lines among all suffixes that are repeated: the pair of ranks of its halves, sorted by Spark's sampled splitters and numbered by
the suffixes before it. Suffixes whose first 2 ** k lines occur nowhere else have no rank and leave the array.

What is deleted are the later copies of repeated runs with ``least_bytes`` or more. The members of an interval of the array whose longest
common prefix weighs so much begin with the same window: the shortest run from there that weighs enough. It is 2 ** k to 2 ** (k + 1) - 1
lines long, and two overlapping ranks of round k, one at its beginning and one at its end, name its interval. A repeated run is the union
of the shortest windows that begin in it and of those that end in it, so the later members of these intervals are, line by line, the later
copies of maximal repeated runs of every length; and no round beyond the longest such window is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store
from .spans import cut_out, merged, placed, sha256

#: A run of lines is deleted only if it has at least so many characters that aren't blank (bytes of UTF-8).
LEAST_BYTES = 40

_KEY = ["d", "u", "q"]
_BLANK = bytes([32, *range(9, 14)])


def lines_of(text: bytes) -> list[bytes]:
    """Lines end at each \\n; none in an empty text."""
    return text.split(b"\n") if text else []


def windows(sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of these weights: lines of the shortest window of weight ``least`` that begins at each, of the one that ends at each (0:
    there is none), and whether a window of two lines or more covers it."""
    n, sums = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    end = np.searchsorted(sums, sums[:-1] + least)
    begin = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ahead, back = np.where(end <= n, end - np.arange(n), 0), np.where(begin >= 0, np.arange(1, n + 1) - begin, 0)
    cover = np.zeros(n + 1, np.int64)
    for at, size in ((np.flatnonzero(ahead > 1), ahead), (np.flatnonzero(back > 1), back)):
        first = at if size is ahead else at + 1 - back[at]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + size[at], -1)
    return ahead, back, np.cumsum(cover)[:-1] > 0


def line_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(d, u, q, p, size, ahead, back, wide, a, b) of each line that isn't blank: its number among those, its number among all lines,
    its weight, its windows, and its 128-bit id. Blank lines have no row, so runs pass over them."""
    names = ["d", "u", "q", "p", "size", "ahead", "back", "wide", "a", "b"]

    def run(batches):
        for part in slices(batches, 2):
            held: list[list[np.ndarray]] = []
            for d, u, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                lines = lines_of(t)
                size = np.fromiter((len(x.translate(None, _BLANK)) for x in lines), np.int64, len(lines))
                p = np.flatnonzero(size)
                if len(p):
                    ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lines[i]) for i in p.tolist()), "<i8").reshape(-1, 2)
                    held.append([np.full(len(p), d), np.full(len(p), u), np.arange(len(p)), p, size[p], *windows(size[p], least_bytes), ids[:, 0], ids[:, 1]])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)

    return placed(docs, text, key).mapInArrow(run, "d long, u long, q long, p long, size long, ahead long, back long, wide boolean, a long, b long")


def _ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rank, fd, fu, fq): for each combination that at least two rows share, how many such rows come before it in order, and its first place.

    Rows are counted before they move, so a combination may be of any size. The order is that of range partitions, each sorted; what
    comes before a partition is added from the partitions' totals, the only thing that is collected.
    """
    shared = rows.groupBy(*by).agg(F.count("*").alias("c"), F.min(F.struct(*_KEY)).alias("f")).where("c > 1")
    ordered = shared.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "f.*", "c")

    def number(batches):
        before = 0
        for batch in batches:
            c = batch.column(len(by) + 3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before + np.cumsum(c) - c), batch.column(len(by) + 3)], names=names)
            before += int(c.sum())

    names = [*by, "fd", "fu", "fq", "rank", "c"]
    numbered = store(ordered.mapInArrow(number, ", ".join(f"{n} long" for n in names)).withColumn("part", F.spark_partition_id()))
    totals = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.sum("c").alias("n")).collect())
    offsets = [(part, sum(n for _, n in totals[:i])) for i, (part, _) in enumerate(totals)]
    at = rows.sparkSession.createDataFrame(offsets, "part int, offset long")
    return numbered.join(F.broadcast(at), "part").select(*by, (F.col("rank") + F.col("offset")).alias("rank"), "fd", "fu", "fq")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows that share their combination with others, with its rank in the place of ``by``. Ranks stand in a stored table and rows are
    plain, so Spark can split a hot combination in the join."""
    return rows.join(_ranks(rows, by), by).drop(*by).withColumnRenamed("rank", "r")


def later_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(d, u, start, size): runs of lines of ``least_bytes`` or more that also start at an earlier place.

    Equal texts with equal ids are one document. At most as many rounds as the logarithm of the lines in the longest shortest window;
    each round's ranks are written to the checkpoint folder, so lineage doesn't grow.
    """
    now = _ranked(line_ids(docs, text, key, least_bytes), ["a", "b"]).dropDuplicates(_KEY)  # rows that repeat stand at one place
    now = store(now.select(*_KEY, "p", F.col("p").alias("last"), "size", F.col("size").alias("left"), F.col("size").alias("right"), "ahead", "back", "wide", "r", "fd", "fu", "fq"))
    later = ~((F.col("d") == F.col("fd")) & (F.col("u") == F.col("fu")) & (F.col("q") == F.col("fq")))
    span = lambda end: [F.col("d"), F.col("u"), F.col("p").alias("start"), (F.col(end) - F.col("p") + 1).alias("size")]
    found = now.where((F.col("ahead") == 1) & later).select(*span("last"))
    now, half = now.where("wide"), 1
    while not now.isEmpty():
        # suffixes ranked by twice as many lines; blocks that no shortest window holds are left out
        nexts = now.select("d", "u", (F.col("q") - half).alias("q"), "last", F.col("size").alias("size2"), "right", "back", F.col("r").alias("s"))
        twice = now.select(*_KEY, "p", "size", "left", "ahead", "r").join(nexts, _KEY).withColumn("size", F.col("size") + F.col("size2"))
        twice = twice.where(F.col("size") - F.greatest("left", "right") < least_bytes)
        half *= 2
        now = store(_ranked(twice.drop("size2"), ["r", "s"]).drop("fd", "fu", "fq"))
        # windows of half to 2 * half - 1 lines, each by the ranks at its beginning and at its end
        begins = now.where(F.col("ahead").between(half, 2 * half - 1)).select("d", "u", "q", F.col("ahead").alias("lines"))
        ends = now.where(F.col("back").between(half, 2 * half - 1)).select("d", "u", (F.col("q") + half - F.col("back")).alias("q"), F.col("back").alias("lines"))
        spans = begins.union(ends).distinct()
        first = now.select(*_KEY, "p", F.col("r").alias("x"))
        second = now.select("d", "u", F.col("q").alias("q2"), F.col("last").alias("end"), F.col("r").alias("y"))
        runs = spans.join(first, _KEY).withColumn("q2", F.col("q") + F.col("lines") - half).join(second, ["d", "u", "q2"]).select(*_KEY, "p", "end", "lines", "x", "y")
        found = found.union(store(_ranked(runs, ["lines", "x", "y"]).where(later).select(*span("end"))))
    return found


def without(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int, int, int]:
    """The lines that stay, number of lines, of deleted lines, and of maximal deleted runs. A blank line stays if a neighbour with text does."""
    lines = lines_of(text)
    a, e = merged(starts, sizes)
    if not len(a):
        return text, len(lines), 0, 0
    gone = np.zeros(len(lines) + 1, np.int64)
    np.add.at(gone, a, 1)
    np.add.at(gone, e, -1)
    stay = np.cumsum(gone)[:-1] == 0
    full = np.flatnonzero([bool(x.translate(None, _BLANK)) for x in lines])
    before, kept = np.searchsorted(full, np.arange(len(lines))), np.concatenate([[False], stay[full], [False]])
    blank = np.setdiff1d(np.arange(len(lines)), full, assume_unique=True)
    stay[blank] = kept[before[blank]] | kept[before[blank] + 1]
    runs = int(np.count_nonzero(~stay & np.concatenate([[True], stay[:-1]])))
    return b"\n".join([x for x, s in zip(lines, stay.tolist(), strict=True) if s]), len(lines), int((~stay).sum()), runs


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_bytes: int = LEAST_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (default: all) with kept_text (binary), n_lines, n_deleted and n_runs; one row for each row that goes in.

    Null and empty texts have no line. A null id comes after all others; ids that repeat with other texts follow the text's hash; an id
    that isn't a number raises. At least one copy of every line stays in the corpus. Blank lines go with the lines around them. A very
    long text is read whole; its lines travel as rows, one after another, and only the text itself has to fit a task.
    """
    keep = list(docs.columns if keep is None else keep)
    return cut_out(docs, later_copies(docs, text, key, least_bytes), text, key, keep, "kept_text binary, n_lines long, n_deleted long, n_runs long", without)


def digest_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, n_lines, n_deleted, n_runs, kept_sha256) of each row."""

    def work(t, a, n):
        left, *counts = without(t, a, n)
        return (*counts, sha256(left))

    return cut_out(docs, later_copies(docs, text, key, least_bytes), text, key, [key], "n_lines long, n_deleted long, n_runs long, kept_sha256 string", work)
