"""Deduplication of collected pages: by address, by fingerprint, by title, greedily within a task, and against history."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pages, quality, urls
from ..functions import similarity as S
from ..sources.stored import stored
from .keepfirst import ranked, settle

#: Hamming distances: within a task and against history, across sections, in the filter of a task, of a deep task.
WITHIN, ACROSS, CASCADE, DEEP = 12, 5, 5, 3
SIMILAR_TITLE, LEAST_CONTENT = 0.8, 100
#: Blocks that fingerprints are dealt into; each pair of blocks is one task's work at a time.
BLOCKS = 16


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the order given. Minima are combined before the shuffle, so a hot key costs nothing."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def first_by_url(df: DataFrame, *order: Column, url: str = "url") -> DataFrame:
    return keep_first(df, urls.normalize_url(F.col(url)), *order)


def cap_per_domain(df: DataFrame, most: int, *order: Column, url: str = "url", within: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` rows of each host."""
    w = Window.partitionBy(*within, urls.netloc(F.col(url))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def _blocks(df: DataFrame, within: tuple[str, ...], name: str, cells: Callable[[Column], Column]) -> DataFrame:
    """(cell, group, name, within...) of fingerprints (within..., h): a row for each cell that one's block takes part in."""
    block = F.pmod(F.xxhash64("h"), F.lit(BLOCKS)).cast("int")
    told = df.select(*within, F.col("h").alias(name)).where(F.col("h").isNotNull()).distinct().withColumnRenamed(name, "h")
    return told.select(F.explode(cells(block)).alias("cell"), F.xxhash64(*within, F.lit(0)).alias("group"), F.col("h").alias(name), *(F.col(w).alias(f"{w}_{name}") for w in within))


def _compared(most: int, within: tuple[str, ...]):
    """The close fingerprints of a cell: its rows of the left and of the right side."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = [x.column(n).to_numpy() for x, name in ((left, "p"), (right, "q")) for n in ("group", name)]
        i, j = S.close_in_groups(numbers[0], numbers[1].view(np.uint64), numbers[2], numbers[3].view(np.uint64), most)
        sides = [(left, f"{w}_p", i) for w in within] + [(right, f"{w}_q", j) for w in within] + [(left, "p", i), (right, "q", j)]
        return pa.table({name: side.column(name).take(pa.array(at)) for side, name, at in sides})

    return run


def close_prints(left: DataFrame, right: DataFrame, most: int, within: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """(within..., p, q) of fingerprints of left and of right (column h of both) that differ in at most ``most`` bits and agree in the
    columns ``within``; all of them. With ``once`` left and right are the same table, and of each pair only p < q is told.

    Fingerprints are dealt into blocks, and each pair of blocks is a cell that one task compares on arrays. So what moves is each
    fingerprint once a cell of its block, and rows are made of found pairs only.
    """
    some = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    if once:
        cells_left = lambda i: F.transform(F.sequence(i, F.lit(BLOCKS - 1)), lambda j: i * BLOCKS + j)
        cells_right = lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: i * BLOCKS + j)
    else:
        cells_left = lambda i: F.transform(some, lambda j: i * BLOCKS + j)
        cells_right = lambda j: F.transform(some, lambda i: i * BLOCKS + j)
    # a number of partitions keeps adaptive execution from putting cells together, which are few bytes and much work
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [_blocks(df, within, name, cells).repartition(parts, "cell").groupBy("cell") for df, name, cells in ((left, "p", cells_left), (right, "q", cells_right))]
    schema = [T.StructField(f"{w}_{n}", df.schema[w].dataType) for df, n in ((left, "p"), (right, "q")) for w in within] + [T.StructField(n, T.LongType()) for n in "pq"]
    met = sides[0].cogroup(sides[1]).applyInArrow(_compared(most, within), T.StructType(schema))
    for w in within:  # groups met by a hash of them
        met = met.where(F.col(f"{w}_p") == F.col(f"{w}_q"))
    if once:  # both ends of a block's own pairs are found from either side
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOCKS))
        met = met.where((block("p") != block("q")) | (F.col("p") < F.col("q")))
        met = met.withColumns({"p": F.least("p", "q"), "q": F.greatest("p", "q")})
    return met.select(*(F.col(f"{w}_p").alias(w) for w in within), "p", "q")


def print_classes(df: DataFrame, key: str = "id", fingerprint: str = "h") -> DataFrame:
    """(key, class): rows of equal fingerprints are one class, named by its smallest key."""
    first = df.groupBy(fingerprint).agg(F.min(key).alias("class"))
    return df.select(key, fingerprint).join(first, fingerprint).select(key, "class")


def near_pairs(df: DataFrame, most: int, key: str = "id", fingerprint: str = "h") -> DataFrame:
    """(a, b, distance) of classes a < b (print_classes tells who is in them) whose fingerprints differ in at most ``most`` bits.

    Copies are never expanded into pairs. df is read twice; store it where its fingerprints are still to be computed.
    """
    classes = df.groupBy(F.col(fingerprint).alias("h")).agg(F.min(key).alias("k"))
    links = close_prints(classes, classes, most, once=True)
    left, right = classes.select(F.col("h").alias("p"), F.col("k").alias("x")), classes.select(F.col("h").alias("q"), F.col("k").alias("y"))
    return links.join(left, "p").join(right, "q").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), S.hamming(F.col("p"), F.col("q")).alias("distance"))


def title_links(left: DataFrame, right: DataFrame, least: float = SIMILAR_TITLE, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., a, b, similarity) of titles (k, t) of left and of right at ``least`` or more that agree in the columns ``within``.

    Similarity of 0.8 needs a Jaccard similarity of two thirds, so the rarest third of a title's words (prefix filter) holds a shared one.
    """
    jaccard = (least - 0.4) / 0.6
    words = lambda df: df.select(*within, "k", "t", S.title_words(F.col("t")).alias("w")).where(F.size("w") > 0)
    freq = words(left).union(words(right)).select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked_ = words(df).select(*within, "k", F.size("w").alias("m"), F.explode("w").alias("word")).join(freq, "word")
        ranked_ = ranked_.withColumn("r", F.row_number().over(Window.partitionBy(*within, "k").orderBy("n", "word")))
        return ranked_.where(F.col("r") <= F.col("m") - F.ceil(jaccard * F.col("m") - 1e-9) + 1).select(*within, F.col("k").alias(name), "word")

    pairs = prefix(left, "a").hint("merge").join(prefix(right, "b"), [*within, "word"]).select(*within, "a", "b").distinct()
    side = lambda df, name: words(df).select(*within, F.col("k").alias(name), F.col("t").alias(f"t{name}"), F.col("w").alias(f"w{name}"))
    joined = pairs.hint("merge").join(side(left, "a"), [*within, "a"]).hint("merge").join(side(right, "b"), [*within, "b"])
    near = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")) >= jaccard - 1e-9
    return joined.where(near).withColumn("similarity", S.title_similarity("ta", "tb")).where(F.col("similarity") >= least).select(*within, "a", "b", "similarity")


def similar_titles(df: DataFrame, key: str = "id", title: str = "title", least: float = SIMILAR_TITLE) -> DataFrame:
    """(a, b, similarity) of classes a < b of equal titles, each named by its smallest key, at ``least`` or more."""
    titles = df.groupBy(F.col(title).alias("t")).agg(F.min(key).alias("k"))
    return title_links(titles, titles, least).where("a < b")


def _plain_title(title: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))


def not_in_history(df: DataFrame, history: DataFrame, most: int = WITHIN, title: str | None = None) -> DataFrame:
    """Rows (url, h) without an equal address, a near fingerprint or, where ``title`` names a column of both, a similar title in
    ``history`` (url, h). A fingerprint of 0 is near none."""
    seen = history.select(urls.normalize_url(F.col("url")).alias("_u")).distinct()
    left = df.withColumn("_u", urls.normalize_url(F.col("url"))).join(seen, "_u", "left_anti").drop("_u")
    near = close_prints(history.where(F.col("h") != 0), left.where(F.col("h") != 0), most).select(F.col("q").alias("h")).distinct()
    left = left.join(near, "h", "left_anti")
    if title is None:
        return left
    of = lambda x: x.select(_plain_title(title).alias("t")).where("t <> ''").distinct().select(F.col("t").alias("k"), "t")
    known = title_links(of(history), of(left)).select(F.col("b").alias("_t")).distinct()
    equal = of(left).select(F.col("k").alias("_t")).join(of(history).select(F.col("k").alias("_t")), "_t", "left_semi")
    return left.withColumn("_t", _plain_title(title)).join(known.union(equal).distinct(), "_t", "left_anti").drop("_t")


def _told(df: DataFrame, url: str, title: str | None, content: str) -> DataFrame:
    """df with what tells pages apart: _u, _h (null where the compared part of the text is short) and _t."""
    part = S.preview(F.coalesce(F.col(content), F.lit("")))
    return df.withColumn("_u", urls.normalize_url(F.coalesce(F.col(url), F.lit("")))).withColumn("_t", F.lit("") if title is None else _plain_title(title)).withColumn("_h", F.when(F.length(part) >= LEAST_CONTENT, S.simhash(part)))


def _folded(df: DataFrame, group: list[str], order: list[str], most: int, own: Column) -> DataFrame:
    """df with ``reason`` by keep-first in order over each group; ``own`` is null for rows that may stay, else their own reason.

    df has what tells rows apart: _u, _h and _t (null: not compared). Groups may be of any size: nothing is gathered by group.
    """
    kept = [c for c in df.columns if c not in ("_u", "_h", "_t")]
    nodes = ranked(df.withColumn("_own", own), group, order)
    told = nodes.select(F.col("_group").alias("g"), F.col("_node").alias("n"), F.col("_rank").alias("r"), F.col("_u").alias("u"), F.col("_h").alias("h"), F.when(F.col("_t") != "", F.col("_t")).alias("t"), F.col("_own").alias("own"))
    # only rows that may stay need links to others, but rows with a reason of their own may learn a better one through them
    prints = told.where("h IS NOT NULL").select("g", "h").distinct()
    ends = F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"))))
    near = close_prints(prints, prints, most, ("g",), once=True).select("g", ends.alias("e")).select("g", F.concat(F.lit("h"), "e.p").alias("c"), F.concat(F.lit("h"), "e.q").alias("other"))
    titles = told.where("t IS NOT NULL").select("g", F.col("t").alias("k"), "t").distinct()
    like = title_links(titles, titles, within=("g",)).where("a <> b").select("g", F.concat(F.lit("t"), "a").alias("c"), F.concat(F.lit("t"), "b").alias("other"))
    reasons = settle(told, stored(near.unionByName(like)))
    return nodes.hint("merge").join(reasons.withColumnRenamed("n", "_node"), "_node").select(*kept, "reason")


def greedy(df: DataFrame, group: str | list[str], order: str | list[str], most: int = WITHIN, url: str = "url", title: str | None = "title", content: str = "content", history: DataFrame | None = None) -> DataFrame:
    """df with ``reason``: null for rows that stay, else history, url, content or title. Each row is compared with the rows kept before it
    in its group (no column: in the whole table); see keepfirst for how. Without ``title`` titles aren't compared.

    ``history`` (url, h, title) is looked up first, by joins over all groups; what it holds takes no part. Runs jobs while it is called.
    """
    group, order = ([x] if isinstance(x, str) else list(x) for x in (group, order))
    told = _told(df, url, title, content)
    if history is None:
        return _folded(told, group, order, most, F.lit(None).cast("string"))
    told = stored(told.withColumn("_n", F.monotonically_increasing_id()))
    new = not_in_history(told.select("_n", F.col(url).alias("url"), F.coalesce("_h", F.lit(0)).alias("h"), (F.lit(None).cast("string") if title is None else F.col(title)).alias("title")), history, most, None if title is None else "title").select("_n")
    fresh = _folded(told.join(new, "_n", "left_semi").drop("_n"), group, order, most, F.lit(None).cast("string"))
    known = told.join(new, "_n", "left_anti").select(*df.columns, F.lit("history").alias("reason"))
    return fresh.unionByName(known)


def across_sections(df: DataFrame, task: str = "task_id", section: str = "section", order: str = "position", url: str = "url", title: str = "title", content: str = "content", history: DataFrame | None = None) -> DataFrame:
    """The pages of a digest that stay: each section first by itself, then all sections of a task together, with the narrower radius.

    Of the second step failed pages (column success), those without an address and those of under 100 characters take no part.
    """
    own = greedy(df, [task, section], order, WITHIN, url, title, content, history).where(F.col("reason").isNull()).drop("reason")
    fit = own.where(F.coalesce("success", F.lit(True)) & (F.coalesce(url, F.lit("")) != "") & (F.length(F.coalesce(content, F.lit(""))) >= LEAST_CONTENT))
    return greedy(fit, task, [section, order], ACROSS, url, title, content).where(F.col("reason").isNull()).drop("reason")


#: Characters that a page must have, by type of task (fixed values); 100 for all others.
LEAST_BY_TYPE = {"deep": 20, "digest": 50}


def cascade(df: DataFrame, task_type: str, year: int, group: str = "task_id", order: str = "position", url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """df with ``reason``: null for pages that pass and for those that had failed before, else too_short, non_article, duplicate or low_quality.

    The first two and the last are told by columns. Whether a page is a duplicate depends on which pages before it passed, so those that
    are left go through keep-first in order, task by task; pages of a digest aren't compared. A page that fails by quality leaves no trace.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    level, authority = urls.authority_level(F.col(url)), urls.authority_score(F.col(url))
    score, paywall = quality.quality_score(F.col(title), text, F.col(url), year, task_type == "digest"), quality.has_paywall(text)
    final = quality.final_score(authority, score, task_type == "digest")
    early = F.when(F.length(text) < LEAST_BY_TYPE.get(task_type, 100), "too_short").when(pages.classify(text, F.col(url), F.col(title))["page_type"] != "unknown", "non_article")
    low = F.when(quality.is_rejected(task_type, level, authority, final, score, paywall), "low_quality")
    # stored twice, since else the text's expression would stand in each place of the reason, and the reason in the condition
    told = stored(stored(df).withColumn("_early", early))
    done = ~F.col("success") | F.col("_early").isNotNull()
    out = told.where(done).select(*df.columns, F.when(F.col("success"), F.col("_early")).alias("reason"))
    rest = told.where(~done).drop("_early")
    if task_type == "digest":
        return out.unionByName(rest.withColumn("reason", low))
    folded = _folded(_told(rest, url, title, content), [group], [order], DEEP if task_type == "deep" else CASCADE, low)
    return out.unionByName(folded.withColumn("reason", F.when(F.col("reason").isin("url", "content", "title"), "duplicate").otherwise(F.col("reason"))))


def cascade_counts(judged: DataFrame, *by: str) -> DataFrame:
    """(by, total, passed, too_short, non_article, duplicate, low_quality) of judged pages that hadn't failed before."""
    own = judged.where("success")
    return own.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("passed"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("too_short", "non_article", "duplicate", "low_quality")))


def append_fingerprints(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (url_hash, digest_date, ...) that aren't stored yet, one for each key: insert, or ignore."""
    keys = ["url_hash", "digest_date"]
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")

