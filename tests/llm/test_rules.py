"""The rule ensemble: held-out accuracy, compiled rules against plain Python, and odd inputs."""

import math

import pytest

from siftwell.llm import queries, rules

from .helpers import frame

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in queries.op13_quality(spark, FOLDER).collect()}


def test_held_out_accuracy(spark, scored):
    marks = [(scored[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    held = [(r["score"], y) for r, y in marks if r["held_out"]]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(zeros) > 5 and sum(a > b for a in ones for b in zeros) / len(ones) / len(zeros) > 0.97
    assert sum((s >= 0.5) == (y == 1) for s, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored.values())


def test_model_is_the_same_each_time_and_learns_nothing_from_held_out_labels(spark, scored):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("quality", rules.F.when(queries.held_out(), 1 - rules.col("quality")).otherwise(rules.col("quality")))
    model = rules.fit(docs.where(~queries.held_out()), turned.where(~queries.held_out()))
    told, name = rules.score(docs, model, keep=["doc_id"])
    assert all(abs(r[name] - scored[r["doc_id"]]["score"]) < 1e-9 for r in told.collect())


def test_compiled_rules_equal_plain_evaluation(spark):
    model = rules.Ensemble(0.25, [(rules.Rule((("a", 2.0, None), ("b", None, 1.0))), -1.5), (rules.Rule((("a", 5.0, 1.0),)), 0.75)])
    rows = [(float(a), float(b)) for a in range(7) for b in range(3)]
    df = frame(spark, rows, "a double, b double")
    for r in df.select("a", "b", model.score({"a": df["a"], "b": df["b"]}).alias("s")).collect():
        z = 0.25 - 1.5 * (r["a"] <= 2 and r["b"] > 1) + 0.75 * (1 < r["a"] <= 5)
        assert abs(r["s"] - 1 / (1 + math.exp(-z))) < 1e-12
    assert str(model.rules[0][0]) == "a <= 2 and 1 < b"


def test_statistics_of_odd_texts(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "Ab 1.\nAb 1.\n"), (None, "x " * 500000), (4, "Ab 1.\nAb 1.\n")])
    found, name = rules.measured(docs, "text", ["doc_id"])
    got = {r["doc_id"]: r[name].asDict() for r in found.collect()}
    assert set(got[1].values()) == {0.0} and got[1] == got[2] and got[3]["n_words"] == 0
    assert (got[4]["n_words"], got[4]["distinct_words"], got[4]["n_lines"], got[4]["distinct_lines"], got[4]["ended_lines"]) == (4, 0.5, 2, 0.5, 1.0)
    assert got[None]["n_words"] == 500000 and abs(got[None]["distinct_words"] - 1 / 500000) < 1e-12


def test_no_labels_one_label_and_clashing_names(spark):
    docs = frame(spark, [(1, "One.", 5), (2, "Two.", 6), (None, None, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, want in ((none, 0.5), (frame(spark, [(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int"), 0.75)):
        told, name = rules.score(docs, rules.fit(docs, labels))
        assert name == "_score" and [round(r[name], 9) for r in told.collect()] == [want] * 3 and told.columns == ["doc_id", "text", "score", "_score"]
    assert rules.score(docs.limit(0), rules.fit(docs.limit(0), none))[0].count() == 0


def test_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    assert 700 < rules.sample_labels(labels, "doc_id", "quality", 1000).count() < 1300
