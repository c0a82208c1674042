"""Packing, verdicts, extents, trees, exports, polling and state: cases that no query covers."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import quality, text, urls
from siftwell.operators import articles, coverage, digest, lists, tasks, trees, visits
from siftwell.sources import readers, sinks
from siftwell.streaming import visits as streams


def run_once(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize(("level", "final", "score", "want"), [("spam", 99, 99, "reject"), ("low", 70, 49, "reject"), ("low", 60, 50, "review"), ("low", 59, 80, "reject"), ("high", 65, 10, "pass"), ("medium", 64.9, 90, "review"), ("medium", 44.9, 0, "reject")])
def test_verdicts(spark, level, final, score, want):
    assert spark.range(1).select(quality.verdict(F.lit(level), F.lit(float(final)), F.lit(float(score)))).first()[0] == want


def test_known_sources_go_before_the_lists(spark):
    known = spark.createDataFrame([("python.org", 12, "low", True, False), ("x.org", 88, "high", False, False)], "domain string, score int, level string, is_active boolean, is_deleted boolean")
    df = spark.createDataFrame([("https://www.python.org/a",), ("https://x.org/",)], "url string")
    assert sorted((r.authority, r.level) for r in urls.rated(df, "url", known).collect()) == [(12, "low"), (50, "medium")]


@pytest.mark.parametrize(("url", "want"), [("http://a.b.example.co.uk/x", "example.co.uk"), ("https://blog.x.org:80/", "x.org:80"), ("http://localhost/", "localhost"), ("x", "")])
def test_base_domain(spark, url, want):
    assert spark.range(1).select(urls.base_domain(F.lit(url))).first()[0] == want


def test_texts_are_cut_before_paragraphs(spark):
    t, mark = "a" * 70 + "\n\n" + "b" * 10 + "\n" + "c" * 100, text.CUT_MARK
    want = {80: t[:70] + mark, 90: t[:82] + mark, 120: t[:82] + mark, 400: t, 10: t[:10] + mark, 200: t, 183: t}
    for limit, cut in want.items():
        assert spark.range(1).select(text.cut_at_paragraph(F.lit(t), limit).alias("a"), text.cut_at_paragraph(F.lit(t), F.lit(limit)).alias("b")).first() == (cut, cut)


def test_digest_prompt_shares_a_budget(spark):
    rows = [(1, i, c, level, f"t{i}", s, "x" * n) for i, (c, level, s, n) in enumerate([("paper", "low", "s", 900), ("paper", "official", "s", 900), ("paper", "high", None, 900), ("paper", "medium", "s", 900), ("hot_trend", "spam", None, 5000), ("hot_trend", None, None, 50), ("other", "high", "s", 100), (None, "high", "s", 100), ("paper", "high", "s", 0)])]
    df = spark.createDataFrame(rows, "task_id long, page_id long, category string, source_level string, title string, summary string, content string")
    got = digest.pack_digest(df, 10_000, 2_000).orderBy("category", "place").collect()
    modes = {r.page_id: (r.category, r.place, r.mode, len(r.packed or "")) for r in got}
    assert modes[1] == ("paper", 1, "text", 900) and modes[2][:3] == ("paper", 2, "text") and modes[3] == ("paper", 3, "summary", 1) and modes[0] == ("paper", 4, "summary", 1)
    assert modes[5] == ("hot_trend", 1, "text", 50) and modes[4][:3] == ("hot_trend", 2, "text") and modes[7][0] == "tech_article" and 8 not in modes
    assert modes[4][3] == 10_000 // 2 // 4 - 50 + len(digest.CUT_MARK)


def test_extent_similarity():
    assert articles.extent_similarity("the word spark is here", "spark") == 1.0
    assert 0.3 < articles.extent_similarity("a sparc station", "spark") < 0.8 and articles.extent_similarity("nothing", "zz") == 0.0
    long = "filler words " * 50 + "spark sql guide" + " other words" * 50
    assert articles.extent_similarity(long, "spark sql guide") == 1.0


def test_fallback_is_chosen_when_the_query_runs(spark):
    df = spark.createDataFrame([(1, "apache sparc"), (2, "nothing")], "id long, text string")
    assert [r.id for r in articles.search_with_fallback(df, "spark").collect()] == [1]
    assert [r.id for r in articles.search_with_fallback(df, "sparc").collect()] == [1] and articles.search_with_fallback(df, "sparc").collect()[0]["rank"] == 0.5


def test_deep_trees(spark):
    chain = spark.createDataFrame([(i, f"n{i}", i - 1 if i > 1 else None, None) for i in range(1, 6)], "id long, name string, parent_id long, sort int")
    assert trees.closure(chain).count() == 15
    tree = trees.nested_tree(chain).first().tree
    assert tree.count('"id"') == 4 and tree.startswith('[{"id":2') and tree.endswith("}]")
    deeper = chain.union(spark.createDataFrame([(6, "n6", 5, None)], chain.schema))
    with pytest.raises(Exception, match="more than 5 levels"):
        trees.closure(deeper).collect()
    assert trees.closure(deeper, 6).count() == 21


def test_related_articles_fill_up(spark):
    rows = [(1, 1, 50), (2, 1, 40), (3, 2, 90), (4, 2, 80), (5, 3, 70)]
    df = spark.createDataFrame(rows, "id long, category_id long, view_count long")
    assert [(r.id, r.tier) for r in articles.related_articles(df, 1).collect()] == [(2, 0), (3, 1), (4, 1)]
    assert [(r.id, r.tier) for r in articles.related_articles(df, 3).collect()] == [(4, 0), (5, 1)]


def test_rate_limit_of_a_hot_key_over_many_batches(spark):
    rows = [(i, "hot", i * 7 % 1000) for i in range(3000)] + [(5000, "b", None), (5001, "b", 5)]
    df = spark.createDataFrame(rows, "id long, ip string, s long").withColumn("ts", F.when(F.col("s").isNotNull(), F.timestamp_seconds("s")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.id: r.allowed for r in visits.rate_limited(df, 5, 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    start, n = None, 0
    for i, _, s in sorted((r for r in rows if r[1] == "hot"), key=lambda r: (r[2], r[0])):
        if start is None or s - start > 60:
            start, n = s, 0
        n += 1
        assert got[i] == (n <= 5)
    assert got[5000] and got[5001]


def test_hints_need_a_gain_after_the_first_round(spark):
    rows = [(1, 2, "bing", "a", 0.3, "spark sql", "week"), (2, 1, "baidu", "b", 0.9, "spark", "week"), (3, 3, "google", "b", 0.1, "other", "week"), (4, 2, "bing", "b", -0.2, "spark", "day")]
    df = spark.createDataFrame(rows, "id long, round_num int, search_engine string, strategy_type string, score_delta double, search_keyword string, time_range string")
    h = tasks.hint(df, "spark", "week").first()
    assert (h.engine, h.strategy_type, h.related_keywords) == ("bing", "a", ["other", "spark sql"]) and [tuple(x) for x in h.type_scores] == [("a", 0.3), ("b", 0.1)]
    assert tasks.hint(df, "zzz", "never").count() == 0 and tasks.hint(df, " ", "week").count() == 0


def test_same_site_crawls(spark):
    links = spark.createDataFrame([("http://a.x.org/1", "http://b.x.org/2"), ("http://b.x.org/2", "http://y.org/"), ("http://b.x.org/2", "http://x.org/3")], "src string, dst string")
    seeds = spark.createDataFrame([("http://a.x.org/1",)], "url string")
    assert [r.url for r in tasks.crawl(links, seeds, 3, 10, same_site=True).orderBy("position").collect()] == ["http://a.x.org/1", "http://b.x.org/2", "http://x.org/3"]
    assert tasks.crawl(links, seeds, 3, 10).count() == 4


def test_directions(spark):
    e = spark.createDataFrame([(0.5, 0.4, 0.2, 1.0, 0.6, 0.3)], "depth double, angle double, temporal double, diversity double, perspective double, language double")
    r = coverage.direction_scores(e).first()
    assert round(r.depth_score, 4) == 0.39 and round(r.breadth_score, 4) == 0.685


def test_crawl_results_of_pages(spark):
    html = '<html><head><title>T</title><style>x</style></head><body><nav><a href="/a">A one</a> <a href="/b">B two</a> <a href="/c">C three</a></nav><h2>Head</h2><p>Real <b>text</b> of the page.</p><pre>code  here</pre><ul><li>one</li></ul><script>no()</script></body></html>'
    r = {x.page_id: x for x in readers.crawl_results(spark.createDataFrame([(1, "http://x/", html), (2, "http://x/", None)], "page_id long, url string, html string")).collect()}
    assert "## Head" in r[1].markdown and "Real **text** of the page." in r[1].markdown and "code  here" in r[1].raw_markdown and "no()" not in r[1].raw_markdown and "[A one](/a)" in r[1].raw_markdown
    assert "[A one](/a)" not in r[1].markdown and r[1].success and r[1].title == "T" and not r[2].success and r[2].error == "no content"


def test_a_meta_date_that_cannot_be_read_leaves_json_ld_a_chance(spark):
    html = '<meta name="date" content="some day"><script type="application/ld+json">{"@type": "Article", "datePublished": "2024-03-01T10:00:00+08:00"}</script>'
    got = readers.page_metadata(spark.createDataFrame([(html, None)], "html string, url string")).first()
    assert got.published == "2024-03-01T10:00:00+08:00"


def test_sinks_of_rounds_markdown_and_fingerprints(spark, tmp_path):
    rounds = spark.createDataFrame([(1, "2024-01-05 10:00:00"), (2, "2024-02-05 10:00:00")], "id long, created_at string")
    sinks.append_rounds(rounds, str(tmp_path / "r"))
    sinks.append_rounds(rounds, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("month").count().count() == 2
    sinks.write_markdown(spark.createDataFrame([(1, "# a\n\nb"), (2, "c")], "id long, markdown string"), str(tmp_path / "m"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "m" / "task_id=1").glob("*.txt"))).strip() == "# a\n\nb"
    prints = spark.range(1500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("url_hash"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("digest_date"))
    sinks.insert_fingerprints(prints.repartition(1), str(tmp_path / "f"))
    sinks.insert_fingerprints(prints.repartition(1), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1500


def test_logs_and_articles_from_tasks(spark):
    t = spark.createDataFrame([(1, 3, "digest", "2024-01-01", "T", "C"), (2, 3, "single", None, "U", "D"), (3, 4, "digest", "2024-01-02", "V", "E")], "id long, status int, task_type string, digest_date string, ai_title string, ai_full_content string")
    none = spark.createDataFrame([], "task_id long")
    assert [r.task_id for r in sinks.to_daily_logs(t, none).collect()] == [1]


def test_feeds_are_polled_once(spark, tmp_path):
    xml = "<rss><channel><item><title>a</title><link>/p</link><pubDate>Mon, 15 Jan 2024 10:00:00 +0800</pubDate></item><item><link>/q</link></item><item><title>old</title><link>/o</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("https://f.org/rss", xml), ("https://f.org/rss", xml)], "feed_url string, xml string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = run_once(streams.poll_feeds(spark, str(tmp_path / "in"), "2024-01-15 12:00:00"), "polled")
    assert sorted((r.url, r.title) for r in got) == [("https://f.org/p", "a"), ("https://f.org/q", "")]


def test_quality_as_state(spark, tmp_path):
    rows = [(1, i, s) for i, s in enumerate([50.0, 80.0, 0.0, 91.55])] + [(2, 0, 10.0)]
    spark.createDataFrame(rows, "source_id long, visit_time long, score double").coalesce(1).write.parquet(str(tmp_path / "runs"))
    df = spark.readStream.schema("source_id long, visit_time long, score double").parquet(str(tmp_path / "runs"))
    got = {r.source_id: (r.quality, r.runs) for r in run_once(streams.moving_quality(df), "quality", "update")}
    batch = spark.read.parquet(str(tmp_path / "runs"))
    want = {r.source_id: (r.quality, r.runs) for r in tasks.moving_quality(batch, "visit_time").collect()}
    assert got == want and got[2] == (10.0, 1)


def test_small_lists(spark):
    assert spark.range(1).select(text.log_words(F.lit("# Head **bold**"))).first()[0] == len("Head bold")
    assert [r.n for r in lists.by_year(spark.createDataFrame([(1, None), (2, "2024-01-01")], "id long, d string").select("id", F.to_date("d").alias("publish_time"))).collect()] == [1]
