"""Lists and projections on small frames."""

from pyspark.sql import functions as F

from siftwell.operators import lists


def test_filters(spark):
    c = spark.createDataFrame([(1, None, False, 1, "A_b", "a"), (2, 1, True, 1, "B%", "b"), (3, 1, True, 0, "C", "b%c")], "id long, parent_id long, is_leaf boolean, status int, name string, slug string")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(lists.categories_page(c, roots=True)) == [1] and ids(lists.categories_page(c, parent=1, status=1)) == [2] and ids(lists.categories_page(c, keyword="%")) == [2, 3]
    assert ids(lists.leaves(c)) == [2]
    f = spark.createDataFrame([(1, "a.png", "image/png"), (2, "b.pdf", "application/pdf"), (3, "c.txt", "text/plain"), (4, None, None)], "id long, name string, mime_type string")
    assert ids(lists.files_page(f, kind="image")) == [1] and ids(lists.files_page(f, kind="document")) == [2, 3] and ids(lists.files_page(f, name="b.")) == [2] and ids(lists.files_page(f)) == [1, 2, 3, 4]


def test_digests(spark):
    t = spark.createDataFrame([(1, "digest", 3, "A", "2024-01-01", "h1"), (2, "digest", 3, "B", "2024-01-02", None), (3, "digest", 4, "C", "2024-01-03", "h3"), (4, "single", 3, "D", "2024-01-04", "x"), (5, "digest", 3, "", "2024-01-05", "")], "id long, task_type string, status int, ai_title string, digest_date string, digest_highlight string")
    assert lists.latest_digest(t).first().id == 2 and lists.latest_digest(t, "2024-01-01").first().id == 1
    assert [r.digest_highlight for r in lists.highlights(t).collect()] == ["h3", "h1"] and lists.digest_open(t, "2024-01-03").isEmpty()
    p = spark.createDataFrame([(5, "u5", "t", "x" * 9), (2, "u2", "t", "abcdef"), (1, "u1", "t", "y")], "task_id long, url string, page_title string, raw_markdown string")
    assert {(r.url, r["head"]) for r in lists.history_pages(t, p, 2, 3).collect()} == {("u5", "xxx"), ("u2", "abc")}
    fp = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-04")], "h string, digest_date string")
    assert [r.h for r in lists.recent_fingerprints(fp, "2024-01-06").collect()] == ["b"]


def test_documents_and_scores(spark):
    t = spark.createDataFrame([(1, "http://x", ["a", "b"], None), (2, None, None, "written")], "id long, source_url string, ai_tags array<string>, ai_full_content string")
    p = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, "raw")], "task_id long, sort_order int, raw_markdown string")
    got = {r.id: r.document for r in lists.task_document(t, p).collect()}
    assert got[1] == "> http://x\n> a, b\n\none\n\n---\n\ntwo" and got[2].endswith("written")
    runs = spark.createDataFrame([(1, "success", '{"quality_score": 80}'), (1, "failed", "broken"), (1, "success", '{"quality_score": "x"}')], "source_id long, status string, result string")
    assert tuple(lists.source_scores(runs).first()) == (1, 2, 80.0)
    cron = spark.createDataFrame([("0 8 * * 1-5",), ("bad",)], "c string").select(lists.cron_fields(F.col("c")).alias("f")).collect()
    assert cron[0].f.weekday == "1-5" and cron[1].f is None
    conf = spark.createDataFrame([("k", "v", "crawler", False), ("p", "w", "site", True)], "config_key string, config_value string, config_group string, is_public boolean")
    assert lists.settings_of(conf, "crawler").first().config_key == "k" and lists.settings_of(conf, public=True).first().config_key == "p"
