"""Words of writing without blanks: a lexicon learned from the corpus itself, and the likeliest words of each run by it.

A lexicon is a DataFrame (word, n, cost). Costs are whole numbers, a million for a factor of e, so ways of equal likelihood are ties and not
a matter of rounding. No list of words comes from outside.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

IDEOGRAPHS = "[一-鿿]+"
UNIT = 1_000_000
#: Words of a lexicon at most, besides single characters: this bounds what is sent to every task.
SIZE = 100_000


def runs(texts: DataFrame, text: str = "text", pattern: str = IDEOGRAPHS) -> DataFrame:
    """(run, n): the distinct runs of a corpus, and how often each occurs; copies cost nothing from here on."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("run"))
    return found.where(F.col("run") != "").groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _pieces(chars: Column, longest: int) -> Column:
    at = lambda k: F.transform(F.sequence(F.lit(1), F.size(chars) - (k - 1)), lambda i: F.array_join(F.slice(chars, i, F.lit(k)), ""))
    return F.flatten(F.array(*(F.when(F.size(chars) >= k, at(k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1))))


def candidates(counted: DataFrame, longest: int = 4, least: int = 5, cohesion: float = 3.0) -> DataFrame:
    """(word, n) that may be words: all single characters, and strings of up to ``longest`` characters that occur ``least`` times or more and
    ``cohesion`` times as often as either of any two parts would meet by chance."""
    grams = counted.select(F.explode(_pieces(F.split("run", ""), longest)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    grams = stored(grams.where((F.char_length("word") == 1) | (F.col("n") >= least)))
    one, more = grams.where(F.char_length("word") == 1), grams.where(F.char_length("word") > 1)
    total = one.agg(F.sum("n").cast("double").alias("total"))  # one row
    cuts = more.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("i"))
    cuts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("i")).alias("left"), F.substring("word", F.col("i") + 1, F.char_length("word")).alias("right"))
    a, b = grams.select(F.col("word").alias("left"), F.col("n").alias("a")), grams.select(F.col("word").alias("right"), F.col("n").alias("b"))
    weakest = cuts.join(a, "left").join(b, "right").groupBy("word").agg(F.first("n").alias("n"), F.max(F.col("a").cast("double") * F.col("b")).alias("chance"))
    firm = weakest.join(F.broadcast(total)).where(F.col("n") * F.col("total") >= F.lit(cohesion) * F.col("chance")).select("word", "n")
    return one.select("word", "n").unionByName(firm)


def _priced(words: DataFrame, size: int) -> DataFrame:
    """Costs of the ``size`` commonest words; the first by the alphabet of equals."""
    kept = stored(words.orderBy(F.desc("n"), "word").limit(size))
    total = kept.agg(F.sum("n").alias("total"))
    return kept.join(F.broadcast(total)).select("word", "n", F.round((F.ln("total") - F.ln("n")) * UNIT).cast("long").alias("cost"))


def cheapest(run: str, cost: dict[str, int], longest: int, unknown: int) -> list[str]:
    """The words of a run at the least cost; of equals the fewest words, then the longest last one, and so on to the front. A character
    that isn't a word costs ``unknown``."""
    best: list[tuple[int, int]] = [(0, 0)]
    back = [0]
    for j in range(1, len(run) + 1):
        found, at = None, 0
        for i in range(max(0, j - longest), j):
            c = cost.get(run[i:j], unknown if i == j - 1 else None)
            if c is not None and (found is None or (best[i][0] + c, best[i][1] + 1) < found):
                found, at = (best[i][0] + c, best[i][1] + 1), i
        best.append(found)
        back.append(at)
    out, j = [], len(run)
    while j:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def _splitter(lexicon: DataFrame) -> Callable[[str], list[str]]:
    """A function of runs that can be sent to tasks: the lexicon's words go to every worker once."""
    spark = lexicon.sparkSession
    rows = lexicon.select("word", "cost").toArrow().to_pydict()  # at most as many as the lexicon's size
    costs = dict(zip(rows["word"], rows["cost"], strict=True))
    longest, unknown = max(map(len, costs), default=1), max(costs.values(), default=0) + UNIT
    sent = spark.sparkContext.broadcast(costs)
    return lambda run: cheapest(run, sent.value, longest, unknown)


def learn(texts: DataFrame, text: str = "text", pattern: str = IDEOGRAPHS, longest: int = 4, least: int = 5, cohesion: float = 3.0, rounds: int = 2, size: int = SIZE) -> DataFrame:
    """The lexicon (word, n, cost) of a corpus.

    Candidates are counted in all runs of ``pattern``; then in each round the runs are split at the least cost and words are counted anew
    where they were used, so strings that only lie across words go. Null and empty texts have no runs, and a corpus without runs an empty
    lexicon. This runs jobs while it is called.
    """
    counted = stored(runs(texts, text, pattern))
    lexicon = _priced(candidates(counted, longest, least, cohesion), size)
    for _ in range(rounds):
        split = _splitter(lexicon)

        def used(batches: Iterator[pd.DataFrame], split=split) -> Iterator[pd.DataFrame]:
            for b in batches:
                words = pd.Series([split(r) for r in b["run"]], dtype=object)
                yield pd.DataFrame({"word": words, "n": b["n"]}).explode("word").groupby("word", as_index=False)["n"].sum()

        told = counted.mapInPandas(used, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        lexicon = _priced(told.where((F.char_length("word") == 1) | (F.col("n") >= least)), size)
    return lexicon


def words(texts: DataFrame, lexicon: DataFrame, text: str = "text", pattern: str = IDEOGRAPHS, name: str = "words", others: str = "[a-z0-9]+") -> DataFrame:
    """texts with ``name``: the words of each text in order, as structs (word, run, at). Runs of ``pattern`` are split by the lexicon, matches
    of ``others`` in the lower-cased text stand as they are. ``run`` counts runs from 0, ``at`` is the word's place in its run from 1."""
    split = _splitter(lexicon)
    own = re.compile(pattern)

    @F.pandas_udf("array<struct<word: string, run: int, at: int>>")
    def told(found: pd.Series) -> pd.Series:
        out = []
        for pieces in found:
            row = []
            for k, piece in enumerate(pieces):
                at = 1
                for w in split(piece) if own.fullmatch(piece) else [piece]:
                    row.append({"word": w, "run": k, "at": at})
                    at += len(w)
            out.append(row)
        return pd.Series(out, dtype=object)

    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"{pattern}|{others}" if others else pattern), F.lit(0))
    return texts.withColumn(name, told(F.filter(pieces, lambda p: p != "")))


def postings(lexicon: DataFrame) -> Callable[[DataFrame, str, str], DataFrame]:
    """Postings of words for ``sources.postings.refresh``, in place of pairs of ideographs."""

    def of(docs: DataFrame, key: str, text: str) -> DataFrame:
        found = words(docs.select(F.col(key).alias("key"), F.col(text).alias("_text")), lexicon, "_text")
        rows = found.select("key", F.explode("words").alias("w")).select("key", F.col("w.word").alias("token"), (F.col("w.run") * F.lit(1 << 32) + F.col("w.at")).alias("at"))
        return rows.groupBy("key", "token").agg(F.sort_array(F.collect_list("at")).alias("positions"))

    return of


def query_words(lexicon: DataFrame, keyword: str) -> Sequence[str]:
    """The distinct words of a keyword, for ``sources.postings.search``."""
    split = _splitter(lexicon)
    found = re.findall(f"{IDEOGRAPHS}|[a-z0-9]+", keyword.lower())
    return list(dict.fromkeys(w for piece in found for w in (split(piece) if re.fullmatch(IDEOGRAPHS, piece) else [piece])))
