"""Column functions against hand-written expectations."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import dates, pages, quality, similarity, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://www.Example.com/Path/", "example.com/path"), ("http://example.com", "example.com"), ("  https://example.com//  ", "example.com"),
        ("https://example.com/path/?utm_source=google&key=value", "example.com/path/&key=value"), ("https://example.com/a?ref=x", "example.com/a"),
        ("https://example.com/a?id=1&utm_medium=m", "example.com/a?id=1"), ("example.com:8080/#top", "example.com:8080/#top"), (None, None),
    ],
)
def test_normalize_url(spark, raw, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=raw) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://youtube.com/watch", True), ("https://author.baijiahao.baidu.com/x", True), ("https://example.com/login", True), ("https://example.com/cart", True), ("https://example.com/rss", True),
        ("https://example.com/a.pdf", True), ("https://google.com/search?q=x", True), ("https://www.amazon.co.jp/x", True), ("https://zhuanlan.zhihu.com/p/1", True),
        ("https://google.com/maps", False), ("https://www.python.org/docs", False), ("", False), ("just-text", False), (None, False),
    ],
)
def test_exclusion(spark, url, want):
    assert one(spark, urls.is_excluded(F.col("u")), u=url) is want


def test_authority(spark):
    cases = {"https://docs.spring.io/x": 95, "https://medium.com/x": 80, "https://me.github.io/x": 60, "https://youtube.com/x": 5, "https://unknown.example/x": 50, "https://zhihu.com/q": 80, "https://notgithub.com/": 60}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.authority_score(F.col("u")).alias("s")).collect()
    assert {r.u: r.s for r in rows} == cases


def test_category_and_source_name(spark):
    cases = [
        ("https://github.com/a/b/issues/12", "", "tech_article", "GitHub"), ("https://github.com/a/b", "", "open_source", "GitHub"), ("https://x.org/", "New arxiv paper", "paper", "x.org"),
        ("https://x.org/", "awesome spark", "open_source", "x.org"), ("https://x.org/", "动态规划", "tech_article", "x.org"), ("https://me.vercel.app/", None, "tech_article", "Vercel"), ("", "GPT 5", "hot_trend", "未知来源"),
    ]
    got = spark.createDataFrame(cases, "u string, t string, c string, s string").select("c", "s", urls.infer_category(F.col("u"), F.col("t")).alias("gc"), urls.source_name(F.col("u")).alias("gs")).collect()
    assert [(r.gc, r.gs) for r in got] == [(r.c, r.s) for r in got]


@pytest.mark.parametrize(("url", "want"), [("http://localhost/x", True), ("http://10.0.0.1/", True), ("http://172.20.1.1", True), ("http://192.168.1.1:80/", True), ("http://8.8.8.8/", False), ("https://example.com/", False), ("http://[::1]/", True), ("ftp", True), (None, True)])
def test_private_addresses(spark, url, want):
    assert one(spark, urls.is_private(F.col("u")), u=url) is want


def test_redirects(spark):
    assert one(spark, urls.decode_redirect(F.col("u")), u="https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly9leC5jb20vYQ&n=1") == "https://ex.com/a"
    assert one(spark, urls.decode_redirect(F.col("u")), u="https://www.google.com/url?q=https%3A%2F%2Fex.com%2Fb&sa=U") == "https://ex.com/b"
    assert one(spark, urls.decode_redirect(F.col("u")), u="https://ex.com/c") == "https://ex.com/c"


@pytest.mark.parametrize(("t", "want"), [("今天天气真好", 6), ("hello world test", 4), ("Python是最好的语言", 7), ("123 456", 0), (None, 0), ("", 0)])
def test_count_words(spark, t, want):
    assert one(spark, text.count_words(F.col("t")), t=t) == want


def test_markdown(spark):
    md = "# Head\n**bold** and *soft* `code` [link](http://x)\n> quote\n- item\n1. one | two"
    assert one(spark, text.markdown_to_text(F.col("t")), t=md) == "Head bold and soft code link quote item one two"
    assert one(spark, text.summary(F.col("t"), 4), t=md) == "Head..." and one(spark, text.markdown_to_text(F.col("t")), t=None) == ""
    assert one(spark, text.drop_boilerplate(F.col("t")), t="keep\nWe use cookies here\n京ICP备12号\nCopyright 2024 me\nend") == "keep\nend"
    assert one(spark, text.link_text_ratio(F.col("t")), t="[abc](http://x) de") == pytest.approx(0.6)
    assert one(spark, text.html_escape(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"


def test_menus():
    bullets = "\n".join(f"- [Item {i}](/i{i})" for i in range(9))
    assert text.without_menus(pd.Series([f"Intro\n{bullets}\nBody text"]))[0] == "Intro\nBody text"
    assert text.without_menus(pd.Series(["[Home](/) | [Blog](/b) | [About](/a)\nText"]))[0] == "Text"
    assert text.without_menus(pd.Series(["**Web** [Pictures](u) [Video](u)\nText"]))[0] == "Text"
    prose = "- [one](/1) with a long explanation that is not a link\n- [two](/2) and another long explanation"
    assert text.without_menus(pd.Series([prose]))[0] == prose


def test_quality(spark):
    long = "## Head\n- item\n  - nested item\n```\ncode\n```\n" + "word " * 1500
    df = spark.createDataFrame([("Plain title", long, "https://x.org/2025/a"), ("震惊 shocking", "限量 " * 6, "https://x.org/"), ("t", None, None)], "t string, c string, u string")
    got = df.select(quality.quality_score(F.col("t"), F.col("c"), F.col("u"), 2025).alias("q"), quality.structure_points(F.col("c")).alias("s")).collect()
    assert got[0].s == 23 and got[0].q == 25 + 23 + 5 + 25 + 5
    assert got[1].q == 0.0 and got[2].q == 0 + 0 + 5 + 25 + 3
    fresh = lambda u, c="": one(spark, quality.freshness_bonus(F.col("u"), F.col("c"), 2025), u=u, c=c)
    assert (fresh("/2025/"), fresh("/2023/"), fresh("/2020/"), fresh("/x/"), fresh("", "Updated: 2025-01"), fresh("", "2019-05-01")) == (5, 2, 0, 3, 5, 0)
    code = lambda n: one(spark, quality.code_points(F.col("c")), c="```" + "x" * n + "```" + "y" * (94 - n))
    assert code(20) == 25 and code(90) == 11 and one(spark, quality.code_points(F.col("c")), c="y" * 50) == 5
    assert one(spark, quality.final_score(F.lit(95), F.lit(80.0))) == 86.0


def test_page_types(spark):
    cases = {
        "serp": ("约1,000条结果", "https://www.baidu.com/s?wd=x", "x_百度搜索"), "listing": ("\n".join(f"2024-01-0{i} Read more" for i in range(1, 7)), "https://x.org/tag/a", ""),
        "login": ("Forgot password?", "https://x.org/login", ""), "error": ("page not found", "https://x.org/a", "404"), "paywall": ("解锁全文", "https://x.org/vip/", ""), "forum": ("楼主", "https://x.org/thread-1", ""),
        "unknown": ("An ordinary text.", "https://x.org/login-security-guide", "A title"),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()] + [("unknown", None, "https://baidu.com/", "")], "want string, c string, u string, t string")
    got = df.select("want", pages.classify(F.col("c"), F.col("u"), F.col("t")).alias("g")).collect()
    assert [r.g.page_type for r in got] == [r.want for r in got] and all(0 <= r.g.confidence <= 0.95 for r in got)


def test_similarity(spark):
    a, b = ("The quick brown fox jumps over the lazy dog near the river bank today. " * 4 + x for x in ("One ending.", "Another end."))
    assert similarity.simhash_of("") == similarity.simhash_of(None) == similarity.simhash_of("!!") == 0
    assert ((similarity.simhash_of(a) ^ similarity.simhash_of(b)) & (2**64 - 1)).bit_count() <= 12
    assert similarity.features("深度学习框架 ab") == ["zh_深度学", "zh_度学习", "zh_学习框", "zh_习框架", "en_ab"] and similarity.features("深度 a b c")[0] == "zh_深度"
    assert spark.range(1).select(similarity.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long")).alias("h")).first().h == 64
    assert similarity.title_similarity_of("Spark guide", "Spark guide") == 1 and similarity.title_similarity_of("", "x") == 0 == similarity.title_similarity_of("the of", "Spark x")
    assert similarity.title_similarity_of("Spark streaming guide for all", "Spark streaming guide for all!") >= 0.8 > similarity.title_similarity_of("Spark guide", "Cooking rice")


@pytest.mark.parametrize(("raw", "want"), [("2024-01-15T10:20:30Z", "2024-01-15T10:20:30"), ("2024-01-15T10:20:30+08:00", "2024-01-15T10:20:30+08:00"), ("2024-01-15T10:20:30-0330", "2024-01-15T10:20:30-03:30"), ("2024-01-15", "2024-01-15T00:00:00"), ("2024年3月5日", "2024-03-05T00:00:00"), ("2024/3/5", "2024-03-05T00:00:00"), ("January 5, 2024", "2024-01-05T00:00:00"), ("Jan 5, 2024", "2024-01-05T00:00:00"), ("soon", None), (None, None)])
def test_datetimes(spark, raw, want):
    assert one(spark, dates.normalize_datetime(F.col("t")), t=raw) == want
