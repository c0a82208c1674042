"""Words of writing without blanks: the lexicon, the cheapest ways against all ways, and search by words."""

import itertools
import random

from pyspark.sql import functions as F

from siftwell.operators import segment
from siftwell.sources import postings
from siftwell.sources.stored import new_folder

WORDS = ["数据", "分析", "引擎", "分布式", "计算", "语言", "模型", "的", "在", "和"]


def corpus(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS, k=rng.randint(3, 9))) + rng.choice(["。", " spark 4 ", "，"]) + "".join(rng.choices(WORDS, k=4)) for _ in range(n)]


def all_ways(run, longest):
    for cut in itertools.product((False, True), repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(run)]
        way = [run[a:b] for a, b in itertools.pairwise(at)]
        if max(map(len, way)) <= longest:
            yield way


def test_cheapest_equals_all_ways():
    rng = random.Random(3)
    for _ in range(300):
        cost = {"".join(rng.choices("天地人", k=rng.randint(1, 3))): rng.randint(1, 6) for _ in range(rng.randint(0, 12))}
        run = "".join(rng.choices("天地人", k=rng.randint(1, 9)))
        price = lambda way: sum(cost.get(w, 9 if len(w) == 1 else 10**6) for w in way)
        want = min(all_ways(run, 3), key=lambda way: (price(way), len(way), [-len(w) for w in reversed(way)]))  # noqa: B023
        assert segment.cheapest(run, cost, 3, 9) == want, (run, cost)
    assert segment.cheapest("", {}, 1, 1) == [] and segment.cheapest("天" * 100_000, {"天天": 1}, 2, 9) == ["天天"] * 50_000


def test_lexicon_finds_the_words(spark):
    texts = corpus(400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, "no ideographs")], "doc_id long, text string")
    lexicon = segment.learn(df)
    known = {r.word: r for r in lexicon.collect()}
    assert set(WORDS) <= set(known)
    got = {r.doc_id: r.words for r in segment.words(df, lexicon).collect()}
    assert got[-1] == got[-2] == [] and [w.word for w in got[-3]] == ["no", "ideographs"]
    rng, right, total = random.Random(7), 0, 0
    for i in range(400):  # the same draws as the corpus
        first, mark, last = rng.choices(WORDS, k=rng.randint(3, 9)), rng.choice(["。", " spark 4 ", "，"]), rng.choices(WORDS, k=4)
        want = [*first, *mark.strip("。， ").split(), *last]
        found = [w.word for w in got[i]]
        assert "".join(found) == "".join(want)
        total += len(want)
        ends = lambda ws: set(itertools.accumulate(map(len, ws)))
        right += len(ends(found) & ends(want))
    assert right / total > 0.95
    assert all(w.at >= 1 for ws in got.values() for w in ws)


def test_candidates_by_brute_force(spark):
    rows = [("天地天地人", 3), ("人天地", 4), ("地", 2)]
    got = {r.word: r.n for r in segment.candidates(spark.createDataFrame(rows, "run string, n long"), 3, 6, 1.5).collect()}
    grams = {}
    for run, n in rows:
        for k in (1, 2, 3):
            for i in range(len(run) - k + 1):
                grams[run[i : i + k]] = grams.get(run[i : i + k], 0) + n
    total = sum(n for w, n in grams.items() if len(w) == 1)
    firm = lambda w, n: n >= 6 and all(n * total >= 1.5 * grams[w[:i]] * grams[w[i:]] for i in range(1, len(w)))
    assert got == {w: n for w, n in grams.items() if len(w) == 1 or firm(w, n)} and "天地" in got


def test_lexicon_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")
    lexicon = segment.learn(empty)
    assert lexicon.count() == 0
    assert [[w.word for w in r.words] for r in segment.words(empty.where("doc_id = 2"), lexicon).collect()] == [["abc"]]
    assert [[w.word for w in r.words] for r in segment.words(spark.createDataFrame([("天地x",)], "text string"), lexicon).collect()] == [["天", "地", "x"]]


def test_search_by_words(spark):
    df = spark.createDataFrame(list(enumerate(corpus(200, 11))), "doc_id long, text string")
    lexicon, folder = segment.learn(df), new_folder(spark)
    postings.refresh(df, folder, postings=segment.postings(lexicon))
    wanted = segment.query_words(lexicon, "分布式计算")
    found = {r.key for r in postings.search(spark, folder, "分布式计算", wanted).collect()}
    told = segment.words(df, lexicon).select("doc_id", F.transform("words", lambda w: w["word"]).alias("w")).collect()
    assert found == {r.doc_id for r in told if set(wanted) <= set(r.w)} and found
