"""Keywords, relevance, strategies and the text helpers of task answers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import keywords, text
from siftwell.operators import strategy


def test_fragments():
    assert keywords.fragments("容器") == ["容器"] and keywords.fragments("a b cd") == ["cd"]
    assert keywords.fragments("深度学习框架") == ["深度学习框架", "深度", "度学", "学习", "习框", "框架"] and keywords.fragments("  ") == []
    assert keywords.variants(["Spark", "spark", " ", "Flink", "a", "b", "c"]) == ["Spark", "Flink", "a", "b"]


@pytest.mark.parametrize(
    ("keyword", "title", "snippet", "want"),
    [("go", "Good algorithms", "", True), ("zig", "Sigzag", "", False), ("go", "Learn Go now", "", True), ("spring boot", "Boot camp", "", True), ("容器", "容器技术", "", True), ("spark", "Spark horoscope", "", False), ("spark", "", "spark", False), ("apache spark sql", "Unrelated", "apache and spark", True), ("apache spark sql", "Unrelated", "only sql", False), ("spark", None, None, False)],
)
def test_relevance(spark, keyword, title, snippet, want):
    df = spark.createDataFrame([(title, snippet)], "t string, s string")
    assert df.select(keywords.is_relevant(keyword, F.col("t"), F.col("s")).alias("v")).first().v is want


def test_robot_pages(spark):
    df = spark.createDataFrame([("Please solve the CAPTCHA",), ("A text",), (None,)], "t string")
    assert [r.v for r in df.select(keywords.asks_for_human(F.col("t")).alias("v")).collect()] == [True, False, False]


def test_next_strategies(spark):
    dims = ("angle", "depth", "temporal", "diversity", "perspective", "language")
    shape = "task_id int, " + ", ".join(f"{d} double" for d in dims) + ", hinted string"
    high = dict.fromkeys(dims, 0.9)
    evaluated = {
        1: {"angle": 0.5, "depth": 0.4}, 2: {"angle": 0.5, "depth": 0.4}, 3: {"language": 0.35}, 4: {"angle": 0.5, "depth": 0.4, "hinted": "angle"}, 5: {"temporal": 0.1}, 6: {"temporal": 0.1, "perspective": 0.2},
        7: {"diversity": 0.1}, 8: {"diversity": 0.1}, 9: {"language": 0.1, "perspective": 0.59}, 10: {"depth": 0.1}, 11: {"diversity": 0.3}, 12: {"angle": 0.58, "depth": 0.5, "hinted": "angle"},
    }
    e = spark.createDataFrame([(t, *((high | v)[d] for d in dims), v.get("hinted")) for t, v in evaluated.items()], shape)
    tasks = [(t, {5: "spark", 6: "容器", 8: "容器"}.get(t, "spark"), "bing", "all" if t == 6 else "day", {"google": 0.2, "sogou": 0.1} if t == 11 else None) for t in evaluated]
    tasks = spark.createDataFrame(tasks, "task_id int, keyword string, engine string, time_range string, engine_scores map<string,double>")
    tried = [(1, 1, "depth", "spark architecture deep dive", "bing", None, "keyword_refine"), (1, 2, "angle", "spark", "bing", None, "x"), (2, 1, "depth", "a", "bing", None, "x"), (2, 2, "depth", "b", "bing", None, "x")]
    tried += [(8, i, "diversity" if i < 3 else "depth", "容器", g, s, "x") for i, (g, s) in enumerate([("baidu", None), ("sogou", None), ("google", "site:github.com"), ("bing", None)], 1)] + [(9, 1, "language", "spark", "bing", None, "cross_language")]
    words = strategy.V.STRATEGY_SUFFIXES_EN["depth"]
    tried += [(10, i, "x", f"spark {w}", "bing", None, "x") for i, w in enumerate(words)]
    history = spark.createDataFrame(tried, "task_id int, round_num int, target_dimension string, keyword string, engine string, site string, kind string")
    got = {r.task_id: (r.dimension, r.kind, r.keyword, r.engine, r.time_range, r.site) for r in strategy.next_strategies(e, tasks, history, 2025).collect()}
    assert got == {
        1: ("depth", "keyword_refine", "spark internals implementation", "bing", "day", None), 2: ("angle", "keyword_refine", "spark comparison vs alternatives", "bing", "day", None),
        4: ("angle", "keyword_refine", "spark comparison vs alternatives", "bing", "day", None), 5: ("temporal", "time_adjust", "spark", "bing", "week", None), 6: ("perspective", "keyword_refine", "容器 缺点 限制", "bing", "all", None),
        7: ("diversity", "engine_switch", "spark", "baidu", "day", None), 8: ("diversity", "site_scope", "容器 site:juejin.cn", "bing", "day", "site:juejin.cn"), 9: ("perspective", "keyword_refine", "spark downsides limitations", "bing", "day", None),
        10: ("depth", "keyword_refine", "spark 2025 latest", "bing", "day", None), 11: ("diversity", "engine_switch", "spark", "google", "day", None), 12: ("depth", "keyword_refine", "spark architecture deep dive", "bing", "day", None),
    }


def test_sections_and_sources(spark):
    s = spark.createDataFrame([("a", 70.0, 0.9, 5, False), ("b", 45.0, 0.5, 5, False), ("c", 90.0, 0.9, 2, False), ("d", 99.0, 0.1, 9, True), ("e", None, 0.0, 0, None)], "name string, avg_quality double, success_rate double, total_runs int, dead boolean")
    assert {r.name: (r.freshness_multiplier, r.items_multiplier) for r in strategy.overrides(s).collect()} == {"a": (2.0, 1.5), "b": (1.5, 1.0), "c": (1.0, 1.0), "d": (1.0, 1.0), "e": (1.0, 1.0)}
    assert strategy.pick_section(s, s.where("name = 'c'")).first().name == "a"
    src = spark.createDataFrame([(1, 0, 3), (2, 1, 1), (3, 3, 1)], "id int, success_count int, fail_count int")
    assert [r.id for r in strategy.sources_to_skip(src).collect()] == [1]
    rounds = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.8), (2, 1, 0.3), (2, 2, 0.5), (2, 3, 0.51), (3, 1, 0.1)], "task_id int, round_num int, overall_score double")
    assert {r.task_id: r.stop for r in strategy.should_stop(rounds).collect()} == {1: True, 2: True, 3: False}


def test_navigation_and_cuts(spark):
    assert text.without_navigation(pd.Series(["Home / Blog / Post\n[Home](/) > [Blog](/b) > [Post](/p)\nReal text with words"]))[0] == "Real text with words"
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("v")).first().v
    assert one(text.first_paragraph(F.col("t")), "# Head\n\nFirst line\nsecond line.\n\nNext") == "First line second line."
    assert one(text.first_paragraph(F.col("t"), 20), "A sentence is here. And more follows.") == "A sentence is here." and one(text.first_paragraph(F.col("t")), None) == ""
    assert one(text.cut_at_paragraph(F.col("t"), 10, "#"), "12345678\n\nabcdef") == "12345678#" and one(text.cut_at_paragraph(F.col("t"), 10, "#"), "short") == "short"
    assert one(text.fit_or_raw(F.lit("fit text"), F.col("t")), "raw " * 100).startswith("raw") and one(text.fit_or_raw(F.lit("fit text"), F.col("t")), "raw") == "fit text"
