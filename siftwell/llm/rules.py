"""Quality by a sparse ensemble of rules: tree paths over text statistics, weighted by a lasso logistic fit, run as one Spark expression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, store
from .filters import words

#: Labelled rows that a model is fitted on at most, about: above it, a share of them by a hash of their ids.
SAMPLE = 20_000
#: Trees, their depth, the weight of the lasso penalty, and the seed of the trees.
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 7


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, upper, lower): lower < statistic <= upper, either end open where None."""

    terms: tuple[tuple[str, float | None, float | None], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The rule as a boolean Spark column."""
        held = F.lit(True)
        for name, upper, lower in self.terms:
            if upper is not None:
                held = held & (stats[name] <= F.lit(upper))
            if lower is not None:
                held = held & (stats[name] > F.lit(lower))
        return held

    def __str__(self) -> str:
        return " and ".join(f"{'' if lo is None else f'{lo:.6g} < '}{name}{'' if up is None else f' <= {up:.6g}'}" for name, up, lo in self.terms)


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights, and the intercept; ``fitted`` tells how many rows taught it."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    fitted: int = 0

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1, a sum of conditional weights through the logistic function."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, none of which knows a language: lengths, repetition of words and lines, and shares of kinds of characters.

    Shares of an empty text are 0. Characters are code points; a count of a kind is what is lost when its runs are deleted.
    """
    w, lines = words(text), F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    n_chars, n_words, n_lines = F.length(text), F.size(w), F.size(lines)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")
    count = lambda kind: n_chars - F.length(F.regexp_replace(text, kind, ""))
    return {
        "n_words": n_words.cast("double"), "distinct_words": share(F.size(F.array_distinct(w)), n_words), "word_length": share(n_chars, n_words),
        "n_lines": n_lines.cast("double"), "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines), "words_a_line": share(n_words, n_lines),
        "capitals": share(count(r"\p{Lu}+"), n_chars), "letters": share(count(r"\p{L}+"), n_chars), "digits": share(count("[0-9]+"), n_chars),
        "stops": share(count("[.!?]+"), n_words), "commas": share(count("[,;:]+"), n_words), "symbols": share(count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"), n_chars),
        "ended_lines": share(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?]\s*$"))), n_lines),
    }


def measured(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, str]:
    """docs' columns ``keep`` and a struct of all statistics, whose name is returned; a null text is an empty one."""
    name, t = free_name(keep, "stats"), F.coalesce(col(text).cast("string"), F.lit(""))
    return docs.select(*map(col, keep), F.struct(*(c.alias(k) for k, c in statistics(t).items())).alias(name)), name


def sample_labels(labels: DataFrame, key: str, label: str, most: int = SAMPLE) -> DataFrame:
    """(key, y) of labels that are 0 or 1: all rows, or about ``most`` of them, chosen by a hash of the id, so that it is broadcast safely."""
    told = labels.where(col(key).isNotNull() & col(label).isin(0, 1)).select(col(key).alias("k"), col(label).cast("double").alias("y"))
    n = told.count()
    return told if n <= most else told.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < max(1, (most << 20) // n))


def paths(forest, names: list[str]) -> list[Rule]:
    """The conjunctions of all nodes below the roots of a forest, each once, in a fixed order."""
    found: dict[Rule, None] = {}

    def walk(node, limits: dict[str, tuple[float, float]]):
        if limits:
            none = lambda x: None if x in (float("inf"), float("-inf")) else x
            found[Rule(tuple((k, none(up), none(lo)) for k, (up, lo) in sorted(limits.items())))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = names[node.split().featureIndex()], node.split().threshold()
        up, lo = limits.get(name, (float("inf"), float("-inf")))
        walk(node.leftChild(), limits | {name: (min(up, at), lo)})
        walk(node.rightChild(), limits | {name: (up, max(lo, at))})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = SAMPLE) -> Ensemble:
    """Learn from the rows of docs that have a label.

    About ``most`` labelled rows at most teach the model (a documented bound; fewer than that: all), joined to docs by a broadcast, so texts
    don't move. Their statistics are stored, a random forest of shallow trees proposes rules, and a logistic regression with a lasso
    penalty chooses among them. Rows that repeat count as often; labels other than 0 and 1, and null ids, teach nothing. With no row, or
    rows of one label only, the model is a constant, (ones + 1) / (rows + 2).
    """
    taught = docs.join(F.broadcast(sample_labels(labels, key, label, most)), col(key) == F.col("k")).select("k", "y", col(text).alias("t"))
    rows, name = measured(taught, "t", ["k", "y"])
    names = list(rows.schema[name].dataType.names)
    table = store(rows.select("k", "y", *(F.col(f"{name}.{n}").alias(n) for n in names)).repartition(1).sortWithinPartitions("k", "y", *names))  # bounded; one order of rows makes one forest
    ones, total = table.agg(F.sum("y"), F.count(F.lit(1))).first()
    ones = int(ones or 0)
    odds = (ones + 1) / (total - ones + 1)
    if not 0 < ones < total:
        return Ensemble(math.log(odds), [], total)
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(table).select("x", "y")
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(2, total // 400), featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED).fit(vectors)
    rules = paths(forest, names)
    if not rules:
        return Ensemble(math.log(odds), [], total)
    held = table.select("y", *(r.column({n: F.col(n) for n in names}).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    fires = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("x", "y")
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, tol=1e-4).fit(fires)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if w], total)


def score(docs: DataFrame, model: Ensemble, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns ``keep`` (default: all) and the score of each whole text, a double from 0 to 1, whose name is returned.

    Null and empty texts are scored as empty ones, by the rules that hold at zero. Rows neither move nor vanish; repeated rows score alike.
    """
    keep = list(docs.columns if keep is None else keep)
    found, name = measured(docs, text, keep)
    out, stats = free_name(keep, "score"), found.schema[name].dataType.names
    return found.select(*map(col, keep), model.score({n: col(name)[n] for n in stats}).alias(out)), out
