"""How varied a set of results is: sources, languages, angles, depth, time and points of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import CJK


def diversity(results: DataFrame, group: str, source: str = "domain") -> DataFrame:
    """(group, diversity): entropy of sources over its maximum, less for under five sources; 0 for a single result."""
    per = results.groupBy(group, source).agg(F.count("*").alias("c"))
    n = F.sum("c")
    # entropy = log2(n) - sum(c log2 c) / n
    entropy = F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n
    value = F.when(n > 1, F.least(F.lit(1.0), F.try_divide(entropy, F.log2(n)) * F.least(F.lit(1.0), F.count("*") / 5))).otherwise(0.0)
    return per.groupBy(group).agg(value.alias("diversity"))


def language_mix(total: Column, cjk: Column, latin: Column) -> Column:
    """From numbers of titles with ideographs and with Latin words."""
    a, b = cjk / total, latin / total
    both, one = (a > 0.1) & (b > 0.1), (a > 0.1) | (b > 0.1)
    return F.when(both, F.bround(F.least(F.lit(1.0), F.try_divide(2 * a * b, a + b) * 1.4), 3)).when(one, F.bround(0.3 + 0.15 * F.least(F.lit(1.0), total / 10), 3)).otherwise(0.0)


def overall(angle: Column, diversity: Column, depth: Column, temporal: Column, perspective: Column, language: Column) -> Column:
    """Weighted sum, three decimals."""
    w = V.COVERAGE_WEIGHTS
    return F.bround(w["angle"] * angle + w["diversity"] * diversity + w["depth"] * depth + w["temporal"] * temporal + w["perspective"] * perspective + w["language"] * language, 3)


def evaluate(results: DataFrame, group: str, domain: str = "domain", title: str = "title", content: str = "content") -> DataFrame:
    """All scores of each group of results, by rules that look at counts, lengths and words alone."""
    one = F.lit(1.0)
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[一-鿿a-zA-Z]+"), F.lit(0))
    holds = lambda list_: F.arrays_overlap(words, F.array(*map(F.lit, list_)))
    size = F.length(F.coalesce(content, F.lit("")))
    base = results.groupBy(group).agg(
        F.count("*").alias("n"), F.countDistinct(domain).alias("sources"), F.avg(size).alias("mean"), F.max(size < 500).alias("short"), F.max(size > 3000).alias("long"),
        F.max(holds(V.POSITIVE_WORDS)).alias("pos"), F.max(holds(V.NEGATIVE_WORDS)).alias("neg"), F.count_if(F.col(title).rlike(CJK)).alias("cjk"), F.count_if(F.col(title).rlike("[a-zA-Z]{3,}")).alias("latin"),
    )
    n, s = F.col("n"), F.col("sources")
    angle = F.bround(F.when(n >= 3, F.least(one, s / 5)).otherwise(F.least(one, n / 3)), 3)
    depth = F.bround(F.least(one, 0.3 + F.when(F.col("short"), 0.3).otherwise(0.0) + F.when(F.col("long"), 0.4).otherwise(0.0) + F.least(F.lit(0.15), F.col("mean") / 10000)), 3)
    temporal = F.bround(F.when(n >= 2, F.least(one, n / 6)).otherwise(0.2) * 0.6 + F.when(s >= 2, F.least(one, s / 4)).otherwise(0.3) * 0.4, 3)
    words_part = F.when(F.col("pos") & F.col("neg"), 0.8).when(F.col("pos") | F.col("neg"), 0.4).otherwise(0.2)
    perspective = F.bround(F.when(s >= 2, F.least(one, s / 3)).otherwise(0.2) * 0.5 + words_part * 0.5, 3)
    out = base.join(diversity(results, group, domain), group)
    out = out.select(group, "n", "sources", angle.alias("angle"), "diversity", depth.alias("depth"), temporal.alias("temporal"), perspective.alias("perspective"), language_mix(n, F.col("cjk"), F.col("latin")).alias("language"))
    cols = [F.col(c) for c in ("angle", "diversity", "depth", "temporal", "perspective", "language")]
    weak = F.array_compact(F.array(F.when(n < 3, "few results"), F.when((s < 3) & (n >= 3), "few sources")))
    advice = F.array_compact(F.array(F.when(n < 3, "other keywords or engine"), F.when((s < 3) & (n >= 3), "other engine")))
    return out.withColumn("overall", overall(*cols)).withColumn("weaknesses", F.array_join(weak, ",")).withColumn("suggestions", F.array_join(advice, ","))


#: Weights of the first, second and third dimension of a direction (fixed values).
DIRECTION_WEIGHTS = (0.4, 0.35, 0.25)


def direction_scores(evaluated: DataFrame) -> DataFrame:
    """evaluated with depth_score (depth, angle, temporal) and breadth_score (diversity, perspective, language)."""
    weighted = lambda names: sum((F.col(c) * w for c, w in zip(names, DIRECTION_WEIGHTS, strict=True)), F.lit(0.0))
    return evaluated.withColumn("depth_score", weighted(("depth", "angle", "temporal"))).withColumn("breadth_score", weighted(("diversity", "perspective", "language")))


def weakest(df: DataFrame, threshold: float = 0.6, language_threshold: float = 0.3) -> DataFrame:
    """df with ``target``: the lowest dimension under its threshold, null if none is; the next search is aimed at it."""
    dims = ("angle", "diversity", "depth", "temporal", "perspective", "language")
    low = F.array_compact(F.array(*[F.when(F.col(d) < (language_threshold if d == "language" else threshold), F.struct(F.col(d).alias("v"), F.lit(i).alias("i"), F.lit(d).alias("d"))) for i, d in enumerate(dims)]))
    return df.withColumn("target", F.array_min(low)["d"])
