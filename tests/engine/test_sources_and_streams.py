"""Feeds, metadata, result pages, sinks, and streams compared with batch."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import visits
from siftwell.sources import readers, selectors, sinks
from siftwell.streaming import visits as streams

RSS = """<rss version="2.0"><channel><item><title>New</title><link>https://f.org/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Old</title><link>https://f.org/2</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Ahead</title><link>https://f.org/3</link><pubDate>Tue, 16 Jan 2024 23:00:00 GMT</pubDate></item>
<item><title>Undated</title><link>/rel</link></item><item><title>Undated 2</title><link>https://f.org/5</link></item><item><title></title><link>https://f.org/6</link></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="alternate" href="https://a.org/1"/><updated>2024-01-15T09:00:00Z</updated></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([("https://f.org/rss", RSS), ("https://a.org/atom", ATOM), ("https://b.org/", "<broken"), ("https://n.org/", None)], "feed_url string, xml string")
    entries = readers.read_feeds(df)
    assert entries.count() == 7
    got = {(r.title, r.url) for r in readers.fresh_entries(entries, "2024-01-15 12:00:00", 24, 5).collect()}
    assert got == {("New", "https://f.org/1"), ("Undated", "https://f.org/rel"), ("A", "https://a.org/1")}


def test_metadata(spark):
    head = '<html lang="en"><head><meta property="og:title" content="OG"><meta name="description" content="D"><meta name="keywords" content="a, b,,c"><title>T</title><link rel="canonical" href="/c">'
    rows = [
        (1, head + '<meta property="article:published_time" content="2024-01-15T08:00:00Z"></head></html>', "https://x.org/p"),
        (2, '<title> Plain </title><body>Text <time datetime="2024-02-01">x</time></body>', None), (3, "<body>published on January 5, 2024</body>", None),
        (4, '<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "author": {"name": "N"}, "datePublished": "2024-03-01"}]}</script>', None), (5, None, None),
        (6, '<script type="application/ld+json">{broken</script><script>var d="2024-01-01"</script>', None),
    ]
    got = {r.page_id: r for r in readers.page_metadata(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert (got[1].title, got[1].description, got[1].keywords, got[1].language, got[1].canonical, got[1].published) == ("OG", "D", ["a", "b", "c"], "en", "https://x.org/c", "2024-01-15T08:00:00")
    assert (got[2].title, got[2].published) == ("Plain", "2024-02-01T00:00:00") and got[3].published == "2024-01-05T00:00:00"
    assert (got[4].author, got[4].published) == ("N", "2024-03-01") and got[5].title is None and got[6].published is None


def test_result_pages(spark):
    bing = '<ol><li class="b_algo"><h2><a href="https://x.org/1">One <b>x</b></a></h2><p>Snippet 1</p></li><li class="b_algo"><h2><a href="https://x.org/2">Two</a></h2><p>S2</p></li></ol>'
    google = '<div class="g"><div class="yuRUbf"><a href="/url?q=https://x.org/1&amp;sa=U"><h3>One</h3></a></div><div class="VwiC3b">s</div></div><div class="g"><div class=yuRUbf><a href="https://x.org/9"><h3>Nine</h3></a></div></div>'
    results = readers.serp_results(spark.createDataFrame([("bing", "q", bing), ("google", "q", google), ("other", "q", bing), ("sogou", "q", None)], "engine string, query string, html string"))
    assert {(r.engine, r["rank"], r.url, r.title, r.snippet) for r in results.collect()} == {
        ("bing", 1, "https://x.org/1", "Onex", "Snippet 1"), ("bing", 2, "https://x.org/2", "Two", "S2"), ("google", 1, "https://x.org/1", "One", "s"), ("google", 2, "https://x.org/9", "Nine", ""),
    }
    assert [r.url for r in readers.merged_results(results).orderBy("n").collect()] == ["https://x.org/1", "https://x.org/2", "https://x.org/9"]


def test_redirects_of_result_pages(spark):
    sogou = '<div class="vrwrap"><h3><a href="/link?url=a">A</a></h3></div><div class="vrwrap"><h3><a href="/link?url=b">B</a></h3></div><div class="vrwrap"><h3><a href="http://weixin.sogou.com/x">W</a></h3></div><div class="vrwrap"><h3><a href="https://d.org/">D</a></h3></div>'
    bing = '<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly93d3cuYmluZy5jb20vYQ">own</a></h2></li><li class="b_algo"><h2><a href="javascript:void(0)">none</a></h2></li>'
    pages = spark.createDataFrame([("sogou", "q", sogou), ("bing", "q", bing)], "engine string, query string, html string")
    found = spark.createDataFrame([("/link?url=a", "https://a.org/"), ("/link?url=a", "https://a.org/"), ("/link?url=b", "https://www.sogou.com/b"), (None, "x")], "href string, target string")
    assert {(r["rank"], r.url) for r in readers.serp_results(pages).collect()} == {(4, "https://d.org/"), (1, "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly93d3cuYmluZy5jb20vYQ")}
    assert {r.url for r in readers.serp_results(pages, found).where("engine = 'sogou'").collect()} == {"https://a.org/", "https://d.org/"}


def test_wanted_results(spark):
    rows = [("google", "spark", 1, "https://a.org/1", "Spark one", ""), ("bing", "spark", 2, "https://a.org/2", "Spark two", ""), ("bing", "spark", 1, "https://a.org/3", "Spark three", ""), ("bing", "spark", 3, "https://b.org/", "No title", "spark"), ("bing", "other", 1, "https://c.org/", "Spark", "")]
    got = readers.wanted_results(spark.createDataFrame(rows, "engine string, query string, rank int, url string, title string, snippet string"), "spark").collect()
    assert [r.url for r in got] == ["https://a.org/3", "https://a.org/2"]


def test_selectors():
    root = selectors.tree('<ul id="u"><li class="a b">1<li class="b">2<p>x<p>y</ul><div><ul><li data-k="v w">3</li></ul><br><i>4</i></div><script>var a="<b>"</script>')
    texts = lambda s: [n.text() for n in selectors.select(root, s)]
    assert texts("li") == ["1", "2xy", "3"] and texts("#u li") == ["1", "2xy"] and texts(".b.a") == ["1"] and texts("div > li") == [] and texts("div > ul > li, p") == ["x", "y", "3"]
    assert texts("[data-k]") == ["3"] and texts('li[data-k="v w"]') == ["3"] and texts("li[data-k=x]") == [] and texts("div i") == ["4"] and texts("div *") == ["3", "3", "", "4"]
    assert selectors.select_one(root, "i, p").text() == "x" and selectors.select_one(root, "table") is None and root.text() == "12xy34"
    with pytest.raises(ValueError):
        selectors.compiled("li:hover")
    deep = selectors.tree("<div>" * 20000 + "end")
    assert len(selectors.select(deep, "div > div")) == 19999 and deep.text() == "end"


def test_tables_and_lists(spark):
    df = spark.createDataFrame([(1, False, '["a"]'), (2, True, "x"), (3, None, None)], "id long, is_deleted boolean, j string")
    assert [r.id for r in readers.live(df).collect()] == [1, 3]
    assert [r.v for r in df.select(readers.json_list(F.col("j")).alias("v")).collect()] == [["a"], [], []]
    assert readers.lookup(df, id=3).count() == 1 and readers.existing(df.select("id"), df.where("id > 1"), "id").count() == 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "pages")
    sinks.write_pages(spark.createDataFrame([(1, "a"), (2, "b")], "task_id long, url string"), path)
    sinks.replace_tasks(spark.createDataFrame([(2, "c")], "task_id long, url string"), path)
    assert sorted((r.task_id, r.url) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    prints = str(tmp_path / "prints")
    for _ in range(2):
        sinks.insert_fingerprints(spark.createDataFrame([("h1", 5, "2024-01-01"), ("h2", 6, "2024-01-01")], "url_hash string, simhash long, digest_date string"), prints)
    assert spark.read.parquet(prints).count() == 2


def test_two_writers_of_fingerprints(spark, tmp_path):
    path, shape = str(tmp_path / "prints"), "url_hash string, simhash long, digest_date string"
    spark.createDataFrame([("h0", 1, "2024-01-01")], shape).write.partitionBy("digest_date").parquet(path)  # of a time without writers
    sinks.insert_fingerprints(spark.createDataFrame([("h0", 9, "2024-01-01"), ("h1", 2, "2024-01-01")], shape), path)
    late = spark.createDataFrame([("h0", 8, "2024-01-01"), ("h1", 7, "2024-01-01"), ("h1", 3, "2024-01-02")], shape)  # didn't see the others
    late.withColumn("written_at", F.current_timestamp() + F.expr("interval 1 second")).withColumn("writer", F.lit("x")).write.mode("append").partitionBy("digest_date").parquet(path)
    got = sinks.fingerprints(spark, path)
    assert sorted((r.url_hash, r.simhash, str(r.digest_date)) for r in got.collect()) == [("h0", 1, "2024-01-01"), ("h1", 2, "2024-01-01"), ("h1", 3, "2024-01-02")]
    assert got.columns == ["url_hash", "simhash", "digest_date"]
    sinks.insert_fingerprints(late, path)
    assert got.count() == sinks.fingerprints(spark, path).count() == 3


@pytest.fixture
def events(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("article_id"), F.col("user_id").alias("visitor_id"), F.col("ts").alias("visit_time"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_first_visits_equal_batch_distinct(spark, tmp_path, events):
    batch, stream = events
    got = run(streams.first_visits(stream), tmp_path, "append")
    assert got.count() == batch.select("article_id", "visitor_id").distinct().count()


def test_running_state_equals_batch(spark, tmp_path, events):
    batch, stream = events
    got = run(streams.visitor_state(stream), tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, visits.visitor_state(batch).collect()))


def test_streamed_rate_limit_equals_batch(spark, tmp_path):
    rows = [(i, f"ip{i % 3}", 1_700_000_000 + (i * 37) % 500) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, ip string, s long").select("id", "ip", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(streams.rate_limited(stream, 3, 60), tmp_path, "append")
    assert {r.id: r.allowed for r in got.collect()} == {r.id: r.allowed for r in visits.rate_limited(df, 3, 60).collect()}


def test_a_visitor_counts_once_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    from siftwell.streaming import views

    path = str(tmp_path / "views")
    frame = lambda rows: spark.createDataFrame(rows, "article_id long, visitor_id long, s long").select("article_id", "visitor_id", F.timestamp_seconds("s").alias("visit_time"))
    day = 86_400
    batches = [frame([(1, 7, 10), (1, 7, 20), (2, 7, 30)]), frame([(1, 8, day), (1, 7, 60 * day)]), frame([(2, 9, 61 * day)])]
    told = lambda: {(r.article_id, r.pv, r.uv) for r in views.article_counts(views.view_records(spark, path)).collect()}
    for i in (0, 1, 1, 0, 1):
        views.record_views(batches[i], i, path)
    assert told() == {(1, 4, 2), (2, 1, 1)}
    views.compact(spark, path)
    views.record_views(batches[2], 2, path)
    views.record_views(batches[2], 2, path)
    assert told() == {(1, 4, 2), (2, 2, 2)}
    views.compact(spark, path)
    assert told() == {(1, 4, 2), (2, 2, 2)}
    record = {(r.article_id, r.visitor_id): r.views for r in views.view_records(spark, path).collect()}
    assert record == {(1, 7): 3, (1, 8): 1, (2, 7): 1, (2, 9): 1}


def test_running_views_keep_their_state(spark, tmp_path, events):
    from siftwell.streaming import views

    batch, stream = events
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(views.running_views(stream), tmp_path, "update").collect()
    finally:
        spark.conf.unset(key)
    last = {}
    for r in got:
        k = (r.article_id, r.visitor_id)
        last[k] = r if k not in last or r.views > last[k].views else last[k]
    assert {(k, r.views) for k, r in last.items()} == {((r.article_id, r.visitor_id), r.views) for r in visits.visitor_state(batch).collect()}
    assert sum(r.is_new for r in got) == len(last)


def test_feed_lists_equal_the_entries_of_a_batch(spark):
    from siftwell.sources import readers

    def item(i, when):
        return f"<item><title>t{i}</title><link>/p/{i}</link>{f'<pubDate>{when}</pubDate>' if when else ''}</item>"

    dates = [None, "Mon, 15 Jan 2024 10:00:00 GMT", "Mon, 01 Jan 2024 10:00:00 GMT", None, "Mon, 15 Jan 2024 12:30:00 GMT", "Tue, 16 Jan 2024 10:00:00 GMT", None, "Sun, 14 Jan 2024 23:00:00 GMT"]
    xml = "<rss><channel>" + "".join(item(i, dates[i % 8]) for i in range(40)) + "</channel></rss>"
    feeds = spark.createDataFrame([("http://a/feed", xml), ("http://b/feed", "<broken"), ("http://c/feed", xml.replace("/p/1<", "mailto:x<"))], "feed_url string, xml string")
    for most in (3, 10, 50):
        want = sorted(map(tuple, readers.fresh_entries(readers.read_feeds(feeds), "2024-01-15 12:00:00", 24, most).collect()))
        got = sorted(map(tuple, readers.fresh_lists(readers.parsed_feeds(feeds), "2024-01-15 12:00:00", 24, most).collect()))
        assert got == want and got


def test_schedules(spark):
    from datetime import datetime, timedelta

    from siftwell.functions import schedules

    lines = ["*/15 * * * *", "0 8 * * 0-4", "59 23 31 12 *", "5,10-12 */6 * * *", "0 0 30 2 *", "0 0 29 2 0", "61 * * * *", "x * * * *", "* * * *", None, "0 0 1 1-12/3 *", "7/20 3 * * 6"]
    now = datetime(2023, 12, 31, 23, 58, 30)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string").select("id", schedules.parsed(F.col("line")).alias("s"))
    got = {r.id: r.due for r in df.select("id", F.date_format(schedules.next_due(F.col("s"), F.lit(now.isoformat()).cast("timestamp")), "yyyy-MM-dd HH:mm").alias("due")).collect()}

    def allowed(field, low, high):
        out = set()
        for item in field.split(","):
            base, _, step = item.partition("/")
            a, _, b = base.partition("-")
            first, last = (low, high) if base == "*" else (int(a), int(b) if b else high if step else int(a))
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    for i in (0, 1, 2, 3, 10, 11):
        sets = [allowed(f, *schedules.RANGES[n]) for f, n in zip(lines[i].split(), schedules.RANGES, strict=True)]
        t = datetime(2023, 12, 31, 23, 59)
        while not (t.minute in sets[0] and t.hour in sets[1] and t.day in sets[2] and t.month in sets[3] and t.weekday() in sets[4]):
            t += timedelta(minutes=1)
        assert got[i] == t.strftime("%Y-%m-%d %H:%M"), lines[i]
    assert got[5] == "2044-02-29 00:00" and [got[i] for i in (4, 6, 7, 8, 9)] == [None] * 5
