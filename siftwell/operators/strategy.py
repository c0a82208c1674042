"""What to try next for tasks whose coverage is low: one row for each task, from its evaluation and its last rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import CJK

def exhausted(history: DataFrame, group: str = "task_id") -> DataFrame:
    """(group, dimension) of what the last two rounds both aimed at."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("round_num")))
    last = history.withColumn("n", n).where("n <= 2")
    return last.groupBy(group, F.col("target_dimension").alias("dimension")).agg(F.count("*").alias("c")).where("c = 2").drop("c")


def _first_unused(candidates: Column, used: Column) -> Column:
    """The first of an array that another doesn't hold; null if it holds all."""
    return F.try_element_at(F.filter(candidates, lambda c: ~F.array_contains(used, c)), F.lit(1))


def _candidates(year: int) -> dict[str, Column]:
    """What each dimension would try next, null where nothing is left: struct(kind, keyword, engine, time_range, site)."""
    cn, keyword = F.col("keyword").rlike(CJK), F.col("keyword")
    strings = lambda values: F.array(*map(F.lit, values))

    def plan(kind: str, good: Column, **changed: Column) -> Column:
        usual = {"keyword": keyword, "engine": F.col("engine"), "time_range": F.col("time_range"), "site": F.lit(None).cast("string")} | changed
        return F.when(good, F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for n, c in usual.items())))

    def reworded(dimension: str, last: Column | None = None) -> Column:
        words = F.when(cn, strings(V.STRATEGY_SUFFIXES_CN[dimension])).otherwise(strings(V.STRATEGY_SUFFIXES_EN[dimension]))
        tries = F.transform(words, lambda w: F.concat(keyword, F.lit(" "), w))
        found = _first_unused(tries if last is None else F.concat(tries, F.array(last)), F.col("used_keywords"))
        return plan("keyword_refine", found.isNotNull(), keyword=found)

    wider = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.WIDER_RANGES.items() for x in kv]), F.col("time_range"))
    newest = F.concat(keyword, F.lit(f" {year} "), F.when(cn, V.LATEST_CN).otherwise(V.LATEST_EN))
    # engines that haven't been used: by what they gained before, where that is known, then by priority
    scored = F.transform(strings(V.SEARCH_ENGINES), lambda e, i: F.struct((-F.coalesce(F.try_element_at(F.col("engine_scores"), e), F.lit(0.0))).alias("s"), i.alias("i"), e.alias("e")))
    engine = _first_unused(F.transform(F.array_sort(scored), lambda x: x["e"]), F.array_append(F.col("used_engines"), F.col("engine")))
    sites = F.transform(F.when(cn, strings(V.STRATEGY_SITES_CN)).otherwise(strings(V.STRATEGY_SITES_EN)), lambda s: F.concat(F.lit("site:"), s))
    site = _first_unused(sites, F.col("used_sites"))
    return {
        "temporal": plan("time_adjust", wider.isNotNull(), time_range=wider), "depth": reworded("depth", newest), "angle": reworded("angle"), "perspective": reworded("perspective"),
        "diversity": F.coalesce(plan("engine_switch", engine.isNotNull(), engine=engine), plan("site_scope", site.isNotNull(), keyword=F.concat(keyword, F.lit(" "), site), site=site)),
        "language": plan("cross_language", ~F.array_contains(F.col("used_kinds"), "cross_language")),
    }


def next_strategies(evaluations: DataFrame, tasks: DataFrame, history: DataFrame, year: int, dimensions: tuple[str, ...] = V.DEPTH_DIMENSIONS + V.BREADTH_DIMENSIONS, near: float = 0.15, hinted_below: float = 0.55, group: str = "task_id") -> DataFrame:
    """(group, dimension, score, kind, keyword, engine, time_range, site): what each task should search next; tasks without an idea have no row.

    Dimensions are gone through from the weakest on; those at their threshold or more and those that the last two rounds both aimed at are
    passed over, and so are those with nothing left to try. A task's ``hinted`` dimension, where evaluations have the column, goes first
    if it scores under ``hinted_below`` and within ``near`` of the weakest. ``tasks`` holds (group, keyword, engine, time_range) and may hold
    engine_scores (a map); ``history`` (group, round_num, target_dimension, keyword, engine, site, kind) is what was tried.
    """
    of = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    used = history.groupBy(group).agg(*(F.collect_set(c).alias(n) for c, n in (("keyword", "used_keywords"), ("engine", "used_engines"), ("site", "used_sites"), ("kind", "used_kinds"))))
    tired = exhausted(history, group).groupBy(group).agg(F.collect_set("dimension").alias("tired"))
    scores = tasks if "engine_scores" in tasks.columns else tasks.withColumn("engine_scores", F.lit(None).cast("map<string,double>"))
    hinted = F.col("hinted") if "hinted" in evaluations.columns else F.lit(None).cast("string")
    rows = evaluations.select(group, *dimensions, hinted.alias("hinted")).join(scores.select(group, "keyword", "engine", "time_range", "engine_scores"), group).join(used, group, "left").join(tired, group, "left")
    rows = rows.select("*", of(F.col("tired")).alias("_tired")).drop("tired").withColumnRenamed("_tired", "tired")
    for c in ("used_keywords", "used_engines", "used_sites", "used_kinds"):
        rows = rows.withColumn(c, of(F.col(c)))
    ideas, weakest = _candidates(year), F.least(*[F.col(d) for d in dimensions])
    choices = [
        F.when(
            (F.col(d) < V.STRATEGY_THRESHOLDS[d]) & ~F.array_contains("tired", d) & ideas[d].isNotNull(),
            F.struct(F.when((F.col("hinted") == d) & (F.col(d) < hinted_below) & (F.col(d) - weakest <= near), 0).otherwise(1).alias("late"), F.col(d).alias("score"), F.lit(i).alias("i"), F.lit(d).alias("dimension"), ideas[d].alias("plan")),
        )
        for i, d in enumerate(dimensions)
    ]
    best = rows.select(group, F.array_min(F.array_compact(F.array(*choices))).alias("b")).where("b is not null")
    return best.select(group, "b.dimension", "b.score", "b.plan.*")


def pick_section(sections: DataFrame, used: DataFrame) -> DataFrame:
    """The unused section of the highest quality (50 if never scored, dead ones last); the first by name of equals."""
    value = F.when(F.coalesce("dead", F.lit(False)), -1.0).otherwise(F.coalesce("avg_quality", F.lit(50.0)))
    return sections.join(used.select("name"), "name", "left_anti").withColumn("value", value).orderBy(F.desc("value"), "name").limit(1)


def overrides(sections: DataFrame) -> DataFrame:
    """sections with freshness and item multipliers by how well they did; 1 for those with under three runs and for dead ones."""
    known = (F.col("total_runs") >= 3) & ~F.coalesce("dead", F.lit(False))
    good = known & (F.col("avg_quality") >= 60) & (F.col("success_rate") >= 0.6)
    fair = known & (F.col("avg_quality") >= 40) & (F.col("success_rate") >= 0.5)
    return sections.withColumn("freshness_multiplier", F.when(good, 2.0).when(fair, 1.5).otherwise(1.0)).withColumn("items_multiplier", F.when(good, 1.5).otherwise(1.0))


def sources_to_skip(sources: DataFrame) -> DataFrame:
    """Sources with at least three runs and under a fifth of successes."""
    runs = F.col("success_count") + F.col("fail_count")
    return sources.where((runs >= 3) & (F.try_divide(F.col("success_count"), runs) < 0.2))


def should_stop(scores: DataFrame, target: float = 0.75, least_gain: float = 0.03, group: str = "task_id") -> DataFrame:
    """(group, stop) from rounds (group, round_num, overall_score): the target is reached, or round three or later gained too little."""
    w = Window.partitionBy(group).orderBy("round_num")
    gain = F.col("overall_score") - F.lag("overall_score").over(w)
    last = scores.withColumn("gain", gain).groupBy(group).agg(F.max_by(F.struct("round_num", "overall_score", "gain"), "round_num").alias("l"))
    return last.select(group, ((F.col("l.overall_score") >= target) | (F.col("l.round_num") >= 3) & F.coalesce(F.col("l.gain") < least_gain, F.lit(False))).alias("stop"))
