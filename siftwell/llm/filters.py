"""How filters act together: survivors of every subset of filters by one CUBE, and every order of applying them by pairs of subsets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, store

#: White space between words, and the characters that condition D looks for.
SPACES, SYMBOLS = "\t\n\x0b\x0c\r", r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def words(text: Column) -> Column:
    """The maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions A to D: under 200 words; under half of the words distinct; over 2 % capitals A-Z; a symbol out of SYMBOLS."""
    w = words(text)
    n, distinct, capitals = F.size(w), F.size(F.array_distinct(w)), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike(SYMBOLS)}


def copy_counts(rows: DataFrame, same: str, key: str, keys: Sequence[str], name: str) -> DataFrame:
    """(keys..., name, n): rows counted by ``keys`` and by whether a smaller ``key`` holds the same ``same``.

    Only counts travel: rows are added up by (same, keys) with the smallest key and its rows, and the smallest of all is looked up among
    those sums. So a value that a third of all rows share is a few rows when its group is formed. Null keys are smaller or larger than none.
    """
    one = rows.groupBy(same, key, *keys).agg(F.count(F.lit(1)).alias("n"))  # repeated rows become one, so that the least key's rows can be told
    told = F.when(col(key).isNotNull(), F.struct(col(key).alias("k"), F.col("n")))
    sums = one.groupBy(same, *keys).agg(F.sum("n").alias("n"), F.sum(F.when(col(key).isNull(), F.col("n")).otherwise(0)).alias("unkeyed"), F.min(told).alias("least"))
    least = sums.groupBy(same).agg(F.min("least.k").alias("least_key"))
    first = F.col("unkeyed") + F.when(F.col("least.k") == F.col("least_key"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("f"), first.alias("m")), F.struct(F.lit(True).alias("f"), (F.col("n") - first).alias("m")))
    split = sums.join(least, same).select(*keys, F.explode(both).alias("half")).where("half.m > 0")
    return split.groupBy(*keys, F.col("half.f").alias(name)).agg(F.sum("half.m").alias("n"))


def survivors(counted: DataFrame, part: str, flags: Sequence[str]) -> DataFrame:
    """(part, subset, n, good, toxic) for every part and each of the 2^k subsets of filters (bit i: ``flags[i]``): who passes all of them.

    ``counted`` (part, flags..., n, good, toxic) is cubed over the flags and the part; a row of the cube tells its subset by its grouping
    id, and counts as survivors if its selected flags are all false. A subset that nobody survives has zeros.
    """
    k = len(flags)
    cube = counted.cube(*flags, part).agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping_id().alias("g"))
    passed = cube.where((F.col("g") % 2 == 0) & ~F.greatest(*(F.coalesce(col(f), F.lit(False)) for f in flags), F.lit(False)))
    bits = sum((F.when(F.col("g").bitwiseAND(1 << (k - i)) == 0, 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    found = passed.select(F.col(part).alias("p"), bits.alias("s"), *COUNTS)
    whole = counted.select(F.col(part).alias("p")).distinct().select("p", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("s"))
    return whole.join(found, ["p", "s"], "left").select(F.col("p").alias(part), F.col("s").alias("subset"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def interactions(counted: DataFrame, part: str, flags: Sequence[str], letters: Sequence[str]) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What a filter removes depends on the subset applied before it only, so pairs of subsets that differ by one filter are joined, k 2^(k-1)
    a part, and each step of each order looks up its pair. Orders and pairs depend on the number of filters alone and are broadcast.
    """
    spark, k = counted.sparkSession, len(flags)
    full = (1 << k) - 1
    alive = survivors(counted, part, flags)
    weight = [math.factorial(n) * math.factorial(k - 1 - n) for n in range(k)]  # orders that apply exactly these n filters before
    pairs = spark.createDataFrame([(b, letters[i], b | 1 << i, b == full ^ 1 << i, weight[b.bit_count()]) for b in range(1 << k) for i in range(k) if not b >> i & 1], "before int, letter string, after int, last boolean, orders long")
    steps = [("".join(o), j + 1, x, sum(1 << letters.index(y) for y in o[:j])) for o in permutations(letters) for j, x in enumerate(o)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, letter string, before int")
    before = alive.select(part, F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_0") for c in COUNTS))
    after = alive.select(part, F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_1") for c in COUNTS))
    both = before.join(F.broadcast(pairs), "before").join(after, [part, "after"]).select(
        part, "letter", "before", "last", "orders", F.col("n_1").alias("kept"), *((F.col(f"{c}_0") - F.col(f"{c}_1")).alias(m) for c, m in zip(COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True))
    )
    alone = both.groupBy(part, "letter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"), F.sum(F.when(F.col("last"), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    return both.join(alone, [part, "letter"]).join(F.broadcast(steps), ["letter", "before"]).select(
        part, "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source", failures: Mapping[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """The interactions of filters over documents, by part: ``failures`` (default: A to D) on a column ``t``, and ``copies``, which fails
    texts that a smaller id holds anywhere in the table.

    Null texts are empty ones and equal each other. A null part is the empty string. Rows without an id have no labels, fail for no copy and make none
    fail; rows that repeat an id count each, and none of them is smaller than the other. Labels that repeat count once: good (quality 1)
    or toxic (toxic 1) if any of an id's rows says so. Texts are read once and never move: their conditions and a digest of 256 bits do.
    Without documents there are no parts and no rows. Other columns, whatever their names, aren't read.
    """
    chosen = failures or text_failures(F.col("t"))
    letters, given = [*chosen, copies], [f"fails_{i}" for i in range(len(chosen))]  # letters may clash with other names
    flags = [*given, "fails_copy"]
    rows = docs.select(col(key).alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(col(text).cast("string"), F.lit("")).alias("t"))
    told = rows.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), *(F.coalesce(c, F.lit(False)).alias(f) for f, c in zip(given, chosen.values(), strict=True)))
    marks = labels.groupBy(col(key).alias("id")).agg(F.max(F.coalesce(col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    marked = told.join(marks, "id", "left").fillna(False, ["is_good", "is_toxic"])
    counts = copy_counts(marked, "digest", "id", ["part", *given, "is_good", "is_toxic"], "fails_copy")
    one = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    # the sums, one row a part and combination of failures, are read by several branches of the plan, so they are stored
    return interactions(store(counts.groupBy("part", *flags).agg(one("is_good").alias("good"), one("is_toxic").alias("toxic"), F.sum("n").alias("n"))), "part", flags, letters)
