"""Collection tasks, what optimisation rounds teach, source effectiveness, and crawling over a stored link graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, floor, isnan, nan

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.stored import stored

PENDING, CRAWLING, PROCESSING, COMPLETED, FAILED = range(5)


def stats(tasks: DataFrame) -> DataFrame:
    """(total, completed, failed, pending, words)."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return tasks.agg(F.count("*").alias("total"), of(COMPLETED).alias("completed"), of(FAILED).alias("failed"), of(PENDING, CRAWLING, PROCESSING).alias("pending"), F.coalesce(F.sum("total_word_count"), F.lit(0)).cast("long").alias("words"))


def filtered(tasks: DataFrame, status: int | None = None, task_type: str | None = None, keyword: str | None = None, user: int | None = None) -> DataFrame:
    """Only conditions that are given count; a keyword is looked for in address and keyword, taken literally. Newest first."""
    if user is not None:
        tasks = tasks.where(F.col("user_id") == user)
    if status is not None:
        tasks = tasks.where(F.col("status") == status)
    if task_type:
        tasks = tasks.where(F.col("task_type") == task_type)
    if keyword:
        tasks = tasks.where(F.col("source_url").contains(keyword) | F.col("keyword").contains(keyword))
    return tasks.orderBy(F.desc("created_at"), "id")


def stale(tasks: DataFrame, now: str, minutes: int = 30, most: int = 20) -> DataFrame:
    """Unfinished tasks with an external id (where the column exists) that nobody has touched for a while, the oldest first."""
    if "external_id" in tasks.columns:
        tasks = tasks.where(F.col("external_id").isNotNull())
    before = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return tasks.where(F.col("status").isin(PENDING, CRAWLING, PROCESSING) & (F.col("updated_at") < before)).orderBy("updated_at", "id").limit(most)


def progress(completed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(completed * 100 / total).cast("int")).otherwise(0)


def labelled(tasks: DataFrame, statuses: dict[int, str], types: dict[str, str]) -> DataFrame:
    """(id, status_text, type_text, progress, source, summary) for lists: addresses cut at 60 characters, summaries at 200 with dots."""
    name = lambda c, map_: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in map_.items() for x in kv]), c), c.cast("string"))
    summary = F.coalesce("ai_summary", F.lit(""))
    return tasks.select(
        "id", name(F.col("status"), statuses).alias("status_text"), name(F.col("task_type"), types).alias("type_text"), progress(F.col("completed_pages"), F.col("total_pages")).alias("progress"),
        F.substring("source_url", 1, 60).alias("source"), F.when(F.length(summary) > 200, F.concat(F.substring(summary, 1, 200), F.lit("..."))).otherwise(summary).alias("summary"),
    )


def crawl_summary(pages: DataFrame, group: str = "task_id") -> DataFrame:
    """(group, succeeded, crawl_ms, words): durations of successful pages, words of all."""
    return pages.groupBy(group).agg(F.count_if("success").alias("succeeded"), F.sum(F.when(F.col("success"), F.col("crawl_ms")).otherwise(0)).cast("long").alias("crawl_ms"), F.sum("word_count").cast("long").alias("words"))


def effectiveness(rounds: DataFrame, by: str, most: int = 20, gains_only: bool = False) -> DataFrame:
    """(by, rounds, avg_delta, avg_score, improved, max_delta) over all rounds after the first, or those with a gain, best first."""
    counted = (F.col("round_num") > 1) & (F.col("score_delta") > 0) if gains_only else F.col("round_num") > 1
    return rounds.where(counted).groupBy(by).agg(
        F.count("*").alias("rounds"), F.avg("score_delta").alias("avg_delta"), F.avg("overall_score").alias("avg_score"),
        F.count_if(F.col("score_delta") > 0).alias("improved"), F.max("score_delta").alias("max_delta"),
    ).orderBy(F.desc("avg_delta"), by).limit(most)


def knowledge_stats(rounds: DataFrame) -> DataFrame:
    """(tasks, rounds, improved, avg_delta, improvement_rate)."""
    later = F.col("round_num") > 1
    up = F.count_if(later & (F.col("score_delta") > 0))
    return rounds.agg(
        F.countDistinct("task_id").alias("tasks"), F.count("*").alias("rounds"), up.alias("improved"), F.avg(F.when(later, F.col("score_delta"))).alias("avg_delta"),
        F.bround(F.try_divide(up, F.count_if(later)), 2).alias("improvement_rate"),
    )


def hint(rounds: DataFrame, keyword: str, time_range: str, newest: int = 50) -> DataFrame:
    """One row, or none where nothing was gained: the engine and the kind of strategy that gained most, all their mean gains (by name),
    and up to five other keywords. It looks at the ``newest`` best later rounds of that time range or with one of the keyword's first
    three words. Means are compared as they are: to bring them to one scale changes no order."""
    words = keyword.split()[:3]
    if not words:
        return rounds.limit(0).select(F.lit("").alias("engine"))
    like = reduce(lambda a, b: a | b, [F.col("search_keyword").contains(w) for w in words])
    best = rounds.where((F.col("score_delta") > 0) & (F.col("round_num") > 1) & (like | (F.col("time_range") == time_range))).orderBy(F.desc("score_delta"), "id").limit(newest)
    one = F.lit(1).alias("_one")

    def means(by: str) -> DataFrame:
        per = best.groupBy(by).agg(F.avg("score_delta").alias("m"))
        scores = F.array_sort(F.collect_list(F.struct(F.col(by).alias("name"), F.bround("m", 4).alias("mean_delta"))))
        return per.groupBy(one).agg(F.min_by(by, F.struct(-F.col("m"), by)).alias("best"), scores.alias("scores"))

    engines, kinds = means("search_engine").toDF("_one", "engine", "engine_scores"), means("strategy_type").toDF("_one", "strategy_type", "type_scores")
    others = best.groupBy(one).agg(F.slice(F.array_sort(F.collect_set(F.when(F.col("search_keyword") != keyword, F.col("search_keyword")))), 1, 5).alias("related_keywords"))
    return engines.join(kinds, "_one").join(others, "_one").drop("_one")


def effective(rounds: DataFrame, least: float = 0.05, most: int = 20) -> DataFrame:
    """Rounds after the first that gained more than ``least``, best first."""
    return rounds.where((F.col("score_delta") > least) & (F.col("round_num") > 1)).orderBy(F.desc("score_delta"), "id").limit(most)


def deltas(rounds: DataFrame, *ties: str) -> DataFrame:
    """Gain of each round over the one before it in its task; the first has none. ``ties`` settle the order of rounds of one number."""
    w = Window.partitionBy("task_id").orderBy("round_num", *ties)
    return rounds.withColumn("delta", F.round(F.col("overall_score") - F.lag("overall_score").over(w), 4))


def retained(rounds: DataFrame, now: str, days: int = 90) -> DataFrame:
    return rounds.where(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


#: States of a moving quality, in hundredths, that a table of all of them may have.
STATES = 2_000_000


def _moved(a: float, score: float) -> float:
    """The state after one more score: it alone where none is set, else three tenths of it; rounded half up."""
    x = score if a == 0 else 0.7 * a + 0.3 * score
    return x if isnan(x) else floor(x * 100 + 0.5) / 100


def _pieces(low: int, high: int):
    """A function of sorted batches (source_id, score): for each source of a task its rows, its state from nothing, and of the task's first
    source, which may have begun in the task before, also the state that each state before would lead to, as steps (cell, state)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, n, values, leads, first = None, 0, [0.0], None, True

        def told() -> dict:
            """leads tells which of the values each state has come to: nothing first, then the cells in order."""
            steps = []
            if first:
                ends = np.array(values)[leads]
                at = np.flatnonzero(np.r_[True, ends[2:] != ends[1:-1]])
                steps = [{"cell": low + int(i), "state": float(ends[1 + i])} for i in at]
            return {"source_id": key, "part": part, "n": n, "state": float(values[leads[0] if first else 0]), "steps": steps}

        for b in batches:
            done = []
            for k, s in zip(b.column("source_id").to_pylist(), b.column("score").to_pylist(), strict=True):
                if n and k != key:
                    done.append(told())
                    n, first = 0, False
                if not n:
                    key, values = k, [0.0, *(np.arange(low, high + 1) / 100).tolist()] if first else [0.0]
                    leads = np.arange(len(values))
                n += 1
                score = nan if s is None else s
                values = [_moved(a, score) for a in values]
                if len(values) > 1 and len(set(values)) < len(values):  # states that have met stay together
                    values, met = np.unique(values, return_inverse=True)
                    values, leads = values.tolist(), met[leads]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_PIECE)
        if n:
            yield pa.RecordBatch.from_pylist([told()], schema=_PIECE)

    return fold


_PIECE = pa.schema([("source_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("state", pa.float64()), ("steps", pa.list_(pa.struct([("cell", pa.int64()), ("state", pa.float64())])))])


def moving_quality(runs: DataFrame, *order: str) -> DataFrame:
    """(source_id, quality, runs): the first score, then 0.7 of the value before and 0.3 of the new one, two decimals at each step.

    A value of 0 counts as unset, so the next score starts anew. After a run without a score quality is null.

    Each step is rounded, so scores count in order. Runs are dealt by ranges of source and order, so a source may lie in many tasks: each
    folds its piece for all states that a source can have before it (few are left after some steps), and pieces are then put together.
    Scores so far apart that there are over STATES states are folded in one array a source. This runs a job for the least and the greatest
    score while the query is built.
    """
    scores = runs.select(F.col("source_id").cast("long"), *order, F.col("score").cast("double"))
    low, high = scores.agg(F.least(F.min("score"), F.lit(0.0)), F.greatest(F.max("score"), F.lit(0.0))).first()
    if not (high - low) * 100 < STATES:
        return _folded(scores, *order)
    cells = floor(low * 100) - 1, ceil(high * 100) + 1
    dealt = scores.repartitionByRange("source_id", *order).sortWithinPartitions("source_id", *order).select("source_id", "score")
    pieces = dealt.mapInArrow(_pieces(*cells), "source_id long, part int, n long, state double, steps array<struct<cell: long, state: double>>")
    held = F.array_sort(F.collect_list(F.struct("part", "state", "steps")))  # a piece a task
    after = lambda a, p: F.try_element_at(F.filter(p["steps"], lambda s: s["cell"] <= F.round(a * 100)), F.lit(-1))["state"]
    value = F.aggregate(F.slice("held", 2, F.size("held")), F.element_at("held", 1)["state"], after)
    return pieces.groupBy("source_id").agg(held.alias("held"), F.sum("n").alias("runs")).select("source_id", F.when(~F.isnan(value), value).alias("quality"), "runs")


def _folded(runs: DataFrame, *order: str) -> DataFrame:
    half_up = lambda x: F.floor(x * 100 + 0.5) / 100
    scores = F.array_sort(F.collect_list(F.struct(*order, "score")))
    fold = F.aggregate(scores, F.lit(0.0), lambda a, s: F.when(a == 0, half_up(s["score"].cast("double"))).otherwise(half_up(0.7 * a + 0.3 * s["score"])))
    return runs.groupBy("source_id").agg(fold.alias("quality"), F.count("*").alias("runs"))


def run_counters(runs: DataFrame, *order: str) -> DataFrame:
    """(source_id, run_count, success_count, fail_count, last_status), and of runs with a column error last_error, cut at 500 characters."""
    last = F.max_by("ok", F.struct(*order))
    if "error" in runs.columns:
        failed = F.max_by(F.when(~F.col("ok"), F.struct(F.substring("error", 1, 500).alias("e"))), F.struct(*order))["e"]
        return run_counters(runs.drop("error"), *order).join(runs.groupBy("source_id").agg(failed.alias("last_error")), "source_id")
    return runs.groupBy("source_id").agg(F.count("*").alias("run_count"), F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("fail_count"), F.when(last, "success").otherwise("failed").alias("last_status"))


def section_effectiveness(sources: DataFrame) -> DataFrame:
    """(section, avg_quality, success_rate, total_runs, dead) of (section, avg_quality_score, run_count, success_count).

    Sources that were never scored don't count in the mean; a section is dead after three runs with under a fifth of successes.
    """
    rate = F.try_divide(F.sum("success_count"), F.sum("run_count"))
    return sources.groupBy("section").agg(
        F.coalesce(F.round(F.avg(F.when(F.col("avg_quality_score") > 0, F.col("avg_quality_score"))), 1), F.lit(0.0)).alias("avg_quality"),
        F.coalesce(F.round(rate, 2), F.lit(0.0)).alias("success_rate"), F.sum("run_count").cast("long").alias("total_runs"),
        ((F.sum("run_count") >= 3) & (F.coalesce(rate, F.lit(0.0)) < 0.2)).alias("dead"),
    )


def sections(sources: DataFrame) -> DataFrame:
    """(name, source_type, max_items, keyword, time_range, urls, feeds): one section for each category of (category, type, value,
    max_pages, freshness_hours, id). No category means tech_article, no type keyword; other types are left out."""
    kind = F.coalesce("type", F.lit("keyword"))
    rows = sources.withColumn("kind", kind).where(F.col("kind").isin("keyword", "url", "rss"))
    name = F.when(F.coalesce("category", F.lit("")) == "", "tech_article").otherwise(F.col("category"))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("id", "value")))), lambda s: s["value"])
    grouped = rows.groupBy(name.alias("name")).agg(
        pick("keyword").alias("k"), pick("url").alias("urls"), pick("rss").alias("feeds"), F.max("max_pages").alias("max_items"), F.min("freshness_hours").alias("hours"), F.collect_set("kind").alias("kinds")
    )
    from ..functions.dates import time_range

    source_type = F.when(F.size("kinds") > 1, "mixed").otherwise(F.element_at("kinds", 1))
    return grouped.select("name", source_type.alias("source_type"), "max_items", F.array_join("k", " OR ").alias("keyword"), time_range(F.col("hours")).alias("time_range"), "urls", "feeds")


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, same_site: bool = False) -> DataFrame:
    """(url, depth, position): pages reached from ``seeds`` (url) over ``links`` (src, dst), breadth first, each once at its least depth.

    ``same_site`` follows only links whose ends have one registrable domain. One join for each level; what a level finds is stored, so
    plans don't grow with depth. Pages are numbered by depth and address, and cut at max_pages.
    """
    edges = links.where(urls.base_domain(F.col("src")) == urls.base_domain(F.col("dst"))) if same_site else links
    front = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front.url == edges.src).select(F.col("dst").alias("url")).distinct()
        front = stored(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    best = seen.orderBy("depth", "url").limit(max_pages)
    return best.withColumn("position", F.row_number().over(Window.orderBy("depth", "url")))


def section_sources(sources: DataFrame) -> DataFrame:
    """(name, url_sources, rss_sources, effectiveness): what each section of ``sections`` crawls, as arrays of structs in the order of ids, and
    how well that has done.

    ``sources`` holds (id, category, type, value, name, crawl_mode, max_depth, max_pages, freshness_hours, success_count, fail_count,
    avg_quality_score, last_result_count), a table that people keep. Unset settings are single, 1, 10 and 24; unset counts 0. A section of
    keywords only counts as dead; one of addresses is dead after three runs with under a fifth of successes. Means and rates round half to even.
    """
    number = lambda c: F.coalesce(c, F.lit(0))
    known = sources.where(F.coalesce("type", F.lit("keyword")).isin("keyword", "url", "rss"))
    did = F.struct(F.col("id").alias("source_id"), *(number(F.col(c)).alias(c) for c in ("success_count", "fail_count", "avg_quality_score", "last_result_count")))
    whose = [F.col("id").alias("source_id"), F.coalesce("name", F.lit("")).alias("source_name"), did.alias("effectiveness")]
    unset = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    page = F.struct(F.col("value").alias("url"), unset("crawl_mode", "single"), unset("max_depth", 1), unset("max_pages", 10), *whose)
    entries = F.when(number(F.col("max_pages")) == 0, 10).otherwise(F.col("max_pages")).alias("max_entries")
    feed = F.struct(F.col("value").alias("feed_url"), unset("freshness_hours", 24), entries, *whose)
    gathered = lambda kind, s: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("id", s.alias("s"))))), lambda x: x["s"])
    crawled = F.col("type").isin("url", "rss")
    good, bad = (F.coalesce(F.sum(F.when(crawled, number(F.col(c)))), F.lit(0)) for c in ("success_count", "fail_count"))
    rate = F.coalesce(F.try_divide(good, good + bad), F.lit(0.0))
    quality = F.coalesce(F.avg(F.when(crawled & (F.col("avg_quality_score") > 0), F.col("avg_quality_score"))), F.lit(0.0))
    dead = (F.count_if(crawled) == 0) | (good + bad >= 3) & (rate < 0.2)
    name = F.when(F.coalesce("category", F.lit("")) == "", "tech_article").otherwise(F.col("category"))
    return known.groupBy(name.alias("section")).agg(
        gathered("url", page).alias("url_sources"), gathered("rss", feed).alias("rss_sources"),
        F.struct(F.bround(quality, 1).alias("avg_quality"), F.bround(rate, 2).alias("success_rate"), (good + bad).alias("total_runs"), dead.alias("dead")).alias("effectiveness"),
    ).withColumnRenamed("section", "name")
