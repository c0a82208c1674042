"""Operators on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import similarity
from siftwell.operators import articles, coverage, dedup, digest, tasks, trees, visits
from siftwell.plans import catalogue

TREE = [(1, "root", None, 1), (2, "mid", 1, 2), (3, "leaf a", 2, 1), (4, "leaf b", 2, None), (5, "other", None, 3)]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(TREE, "id long, name string, parent_id long, sort int")


def test_tree(spark, nodes):
    counts = spark.createDataFrame([(2, 10), (3, 5), (4, 1)], "id long, n long")
    assert {r.id: r.total for r in trees.rollup_all(nodes, counts).collect()} == {1: 16, 2: 16, 3: 5, 4: 1, 5: 0}
    assert {r.id: r.total for r in trees.rollup_leaves(nodes, counts).collect()} == {1: 6, 2: 6, 3: 5, 4: 1, 5: 0}
    assert {r.id: (r.depth, r.path) for r in trees.paths(nodes).collect()}[3] == (2, "root / mid / leaf a")
    assert {r.id for r in trees.subtree(nodes, 2).collect()} == {2, 3, 4}
    assert trees.would_cycle(nodes, 1, 3) and not trees.would_cycle(nodes, 3, 5)
    assert trees.fits_below(nodes, 2, 5) and not trees.fits_below(nodes, 1, 4, levels=4)
    assert [c.name for c in next(r for r in trees.nested(nodes).collect() if r.id == 2).children] == ["leaf a", "leaf b"]


def test_greedy_dedup_depends_on_what_stayed(spark):
    body = "The quick brown fox jumps over the lazy dog near the river bank today. " * 6
    rows = [
        (1, 1, "http://a/x", "First title here", body), (1, 2, "http://www.a/x/", "Other", "short"), (1, 3, "http://a/y", "Second thing", body + "more"),
        (1, 4, "http://a/z", "First title here", "brief"), (1, 5, "http://a/q", "Unlike anything", "brief"), (2, 6, "http://a/x", "First title here", body), (2, 7, None, None, None),
    ]
    df = spark.createDataFrame(rows, "task_id long, pos long, url string, title string, content string")
    assert {r.pos: r.reason for r in dedup.greedy(df, "task_id", "pos").collect()} == {1: None, 2: "url", 3: "content", 4: "title", 5: None, 6: None, 7: None}


def test_pairs_with_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, 0b1111), (2, 0b1111), (3, 0b1011), (4, -1)], "id long, h long")
    assert {(r.a, r.b, r.distance) for r in dedup.near_pairs(df, 3).collect()} == {(1, 3, 1)}
    assert {(r.id, r["class"]) for r in dedup.print_classes(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_all_pairs_within_twelve_bits_are_found(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 14))) for x in base for _ in range(4)]
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    for most in (3, 5, 12):
        want = {(i, j, d) for j in range(len(prints)) for i in range(j) if 0 < (d := (prints[i] ^ prints[j]).bit_count()) <= most}
        assert {(r.a, r.b, r.distance) for r in dedup.near_pairs(df, most).collect()} == want


def test_fingerprints_are_compared_on_arrays_and_only_found_pairs_become_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    a, b = (base[rng.integers(0, 60, n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (9, n)).astype(np.uint64)) for n in (700, 900))
    ga, gb = (np.concatenate([np.full(400, 5), rng.integers(0, 90, n - 400)]) for n in (700, 900))
    apart = np.bitwise_count(a[:, None] ^ b)
    for most in (0, 3, 5, 12):
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= most)), strict=True))
        for way in (similarity._close_by_scan, similarity._close_by_words):
            found = [pair for i, j in way(a, b, most) for pair in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(found) == len(set(found)) and set(found) == want
        i, j = similarity.close_in_groups(ga, a, gb, b, most)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((x, y) for x, y in want if ga[x] == gb[y])
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 3), (None, 2)], "g long, h long")
    met = dedup.close_prints(df, df, 1, ("g",), once=True)
    assert {tuple(r) for r in met.collect()} == {(1, 0, 1)} and "Join" not in met._jdf.queryExecution().toString()
    assert {tuple(r) for r in dedup.close_prints(df, df, 1).collect()} == {(x, y) for x in range(4) for y in range(4) if (x ^ y).bit_count() <= 1}


@pytest.mark.parametrize("name", ["simhash_pairs_t5", "history_anti", "history_semi"])
def test_no_query_of_fingerprints_meets_by_words(spark, name):
    """Rows of words near each band, and their joins, grow with the square of the fingerprints."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "word" not in plan and "band" not in plan


def test_history_is_looked_up_by_address_fingerprint_and_title(spark):
    old = spark.createDataFrame([("http://a/1", 0b111, "Learn Spark SQL Today"), ("http://a/2", 0, None)], "url string, h long, title string")
    rows = [(1, "https://www.a/1/", -1, "x"), (2, "http://b/2", 0b11, "y"), (3, "http://b/3", 0, "learn spark sql today "), (4, "http://b/4", 0, "Other things"), (5, "http://b/5", -1, None)]
    new = spark.createDataFrame(rows, "id long, url string, h long, title string")
    assert {r.id for r in dedup.not_in_history(new, old, 3, "title").collect()} == {4, 5}
    assert {r.id for r in dedup.not_in_history(new, old, 3).collect()} == {3, 4, 5}


def test_titles_are_compared_without_case_and_blanks(spark):
    rows = [(1, 1, "u1", "Learn Spark SQL Today", ""), (1, 2, "u2", " learn spark sql today", ""), (1, 3, "u3", "Learn Flink", "")]
    df = spark.createDataFrame(rows, "task_id long, pos long, url string, title string, content string")
    assert {r.pos: r.reason for r in dedup.greedy(df, "task_id", "pos").collect()} == {1: None, 2: "title", 3: None}
    old = spark.createDataFrame([("u3", 0, None)], "url string, h long, title string")
    assert {r.pos: r.reason for r in dedup.greedy(df, "task_id", "pos", history=old).collect()} == {1: None, 2: "title", 3: "history"}


def test_sections_of_a_digest_share_what_they_have_seen(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(200))
    rows = [(1, 1, 1, "http://a/1", "one", text(1), True), (1, 2, 1, "http://a/2", "two", text(1), True), (1, 2, 2, "http://a/3", "three", text(2), True), (1, 3, 1, "http://a/3/", "four", text(3), True), (1, 3, 2, "http://a/5", "five", "short", True), (1, 3, 3, "http://a/6", "six", text(4), False), (2, 1, 1, "http://a/1", "one", text(1), True)]
    df = spark.createDataFrame(rows, "task_id long, section long, position long, url string, title string, content string, success boolean")
    assert sorted((r.task_id, r.section, r.position) for r in dedup.across_sections(df).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_cascade_of_reasons(spark):
    text = lambda k: "## Head\n\n```\ncode " + " ".join(f"w{k}x{i}" for i in range(900)) + "\n```\n- a\n- b\n"
    good, other = text(1), text(2)
    rows = [
        (1, 1, "http://docs.python.org/a", "A guide", "tiny", True), (1, 2, "http://docs.python.org/forum-1/t/", "Board", good + " 楼主 沙发", True), (1, 3, "http://docs.python.org/b", "A guide", good, True),
        (1, 4, "http://docs.python.org/b/", "Else", other, True), (1, 5, "http://x.org/c", "Unlike", good, True), (1, 6, "https://www.youtube.com/watch", "Video", text(3), True), (1, 7, "http://docs.python.org/z", "Manual", other, True),
        (1, 8, "http://x.org/q", "Failed", "", False),
    ]
    df = spark.createDataFrame(rows, "task_id long, position long, url string, title string, content string, success boolean")
    got = {r.position: r.reason for r in dedup.cascade(df, "keyword", 2025).collect()}
    assert got == {1: "too_short", 2: "non_article", 3: None, 4: "duplicate", 5: "duplicate", 6: "low_quality", 7: None, 8: None}
    counts = dedup.cascade_counts(dedup.cascade(df, "keyword", 2025)).first()
    assert (counts.total, counts.passed, counts.duplicate) == (7, 2, 2)
    assert {r.position: r.reason for r in dedup.cascade(df, "digest", 2025).collect()}[5] is None


def test_similar_titles_equal_brute_force(spark):
    from siftwell.functions.similarity import title_similarity_of

    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    titles = [" ".join(words[(i * k) % 8] for k in range(1, 6)) for i in range(40)] + ["的 了", "", "深度 学习 框架", "深度 学习 框架!"]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {(r.a, r.b) for r in dedup.similar_titles(df).collect()}
    first = sorted({titles.index(t) for t in titles})
    assert got == {(i, j) for j in first for i in first if i < j and title_similarity_of(titles[i], titles[j]) >= 0.8}


def test_fingerprint_append_ignores_what_is_stored(spark):
    old = spark.createDataFrame([("a", "2024-01-01")], "url_hash string, digest_date string")
    new = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-01"), ("b", "2024-01-01")], "url_hash string, digest_date string")
    assert sorted(tuple(r) for r in dedup.append_fingerprints(old, new).select("url_hash", "digest_date").collect()) == [("a", "2024-01-02"), ("b", "2024-01-01")]


def test_rate_limit_windows_start_at_the_first_request(spark):
    rows = [(i, "x", s) for i, s in enumerate([0, 10, 20, 60, 61, 62, 300, 301])]
    df = spark.createDataFrame(rows, "id long, ip string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.allowed for r in visits.rate_limited(df, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True}


def test_archive_puts_undated_first(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2023-07-01",), (None,), ("2024-01-09",)], "d string").select(F.to_timestamp("d").alias("publish_time"))
    assert [tuple(r) for r in visits.by_period(df).collect()] == [(None, None, 1), ("2024", "01", 2), ("2023", "07", 1)]


def test_moving_quality(spark):
    df = spark.createDataFrame([(1, 1, 50.0), (1, 2, 80.0), (2, 1, 0.0), (2, 2, 33.333)], "source_id long, t long, score double")
    assert {r.source_id: r.quality for r in tasks.moving_quality(df, "t").collect()} == {1: 59.0, 2: 33.33}


def test_sections(spark):
    rows = [(1, None, "keyword", "a", 5, 24), (2, "", "keyword", "b", 9, 200), (3, "news", "keyword", "k", 3, 48), (4, "news", "rss", "http://f", 8, 12), (5, "x", "unknown", "v", 1, 1), (6, "y", None, "w", 2, 24)]
    df = spark.createDataFrame(rows, "id long, category string, type string, value string, max_pages int, freshness_hours int")
    got = {r.name: r for r in tasks.sections(df).collect()}
    assert set(got) == {"tech_article", "news", "y"} and got["tech_article"].keyword == "a OR b" and got["tech_article"].max_items == 9
    assert got["news"].source_type == "mixed" and got["news"].feeds == ["http://f"] and got["news"].time_range == "day" and got["y"].source_type == "keyword"


def test_crawl_is_breadth_first(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "a"), ("d", "e"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert [(r.url, r.depth) for r in tasks.crawl(links, seeds, 2, 10).orderBy("position").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert tasks.crawl(links, seeds, 5, 3).count() == 3


def test_diversity(spark):
    rows = [("one", "a"), ("two", "a"), ("two", "b"), *(("five", x) for x in "abcde"), ("same", "a"), ("same", "a")]
    got = {r.g: round(r.diversity, 6) for r in coverage.diversity(spark.createDataFrame(rows, "g string, domain string"), "g").collect()}
    assert got == {"one": 0.0, "two": 0.4, "five": 1.0, "same": 0.0}


def test_weakest_dimension(spark):
    e = spark.createDataFrame([(0.9, 0.4, 0.7, 0.7, 0.7, 0.35), (0.9, 0.9, 0.9, 0.9, 0.9, 0.9)], "angle double, diversity double, depth double, temporal double, perspective double, language double")
    assert [r.target for r in coverage.weakest(e).collect()] == ["diversity", None]


def test_digest(spark):
    items = spark.createDataFrame([(1, 1, "u", "short"), (2, 1, "u", "longer line"), (3, 1, "u", "longer lin2"), (1, 2, "", "x"), (2, 2, None, "y")], "section long, position long, url string, one_liner string")
    assert sorted((r.section, r.position) for r in digest.distinct_items(items).collect()) == [(1, 2), (2, 1), (2, 2)]
    pages = spark.createDataFrame([(1, "https://x.org/a/"), (1, "https://x.org/b"), (2, "https://y.org/")], "task_id long, url string")
    broken = spark.createDataFrame([(1, "https://x.org/a/"), (1, "x.org/a"), (1, "https://x.org/b?utm=1"), (1, "https://y.org/"), (1, None)], "task_id long, url string")
    assert sorted((r.url or "", r.fixed) for r in digest.repair_urls(broken, pages).collect()) == sorted([("https://x.org/a/", "https://x.org/a/"), ("x.org/a", "https://x.org/a/"), ("https://x.org/b?utm=1", "https://x.org/b"), ("https://y.org/", ""), ("", "")])
    p = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "y" * 80), (1, 3, "z" * 10), (2, 4, None)], "task_id long, page_id long, content string")
    assert {r.page_id: len(r.packed) if r.packed is not None else None for r in digest.pack(p, 100).collect()} == {2: 80, 1: 34, 3: None, 4: 0}
    s = spark.createDataFrame([(1, 9, "News", 2), (2, 9, "Tools", 1)], "id long, task_id long, category_name string, sort_order int")
    i = spark.createDataFrame([(1, 2, "T2", "o2", "u2"), (1, 1, "T1", "o1", "u1")], "section_id long, sort_order int, title string, one_liner string, url string")
    assert digest.export_markdown(digest.sections_with_items(s, i)).first().markdown == "## Tools\n\n\n## News\n- [T1](u1): o1\n- [T2](u2): o2"


def test_answers():
    assert digest.json_in('Sure: ```json\n{"a": 1}\n``` bye') == '{"a": 1}' and digest.json_in('x {bad} {"b": "}"} y') == '{"b": "}"}' and digest.json_in("none") is None is digest.json_in(None)


def test_parsed_answers(spark):
    df = spark.createDataFrame([('{"title": "T", "summary": "S", "tags": ["a", "a", " ", "b"]}',), ('{"summary": "S"}',), ("no",)], "t string")
    got = [r.a for r in df.select(digest.parse_answer(F.col("t")).alias("a")).collect()]
    assert [g.error for g in got] == [None, "no_title", "no_json"] and got[0].tags == ["a", "b"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Spark streaming and spark sql"), (2, "Flink streaming"), (3, "深度学习框架"), (4, None)], "id long, text string")
    assert [r.id for r in articles.search(docs, "spark Streaming").collect()] == [1]
    assert [r.id for r in articles.search(docs, "学习").collect()] == [3] and articles.search(docs, "").count() == 4
    assert [r.id for r in articles.search_with_fallback(docs, "sparc").orderBy(F.desc("rank")).limit(1).collect()] == [1]


def test_related_articles_fill_up(spark):
    a = spark.createDataFrame([(1, 1, 5), (2, 1, 9), (3, 2, 100), (4, 2, 50), (5, 3, 70)], "id long, category_id long, view_count long")
    assert [(r.id, r.tier) for r in articles.related_articles(a, 1).collect()] == [(2, 0), (3, 1), (5, 1)]


def test_quality_of_sources_over_several_tasks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice([0.0, 0.004, 0.01, -1.5, rng.uniform(0, 100)]) if i % 50 < 3 else rng.uniform(0, 100)) for i in range(3000)]
    rows += [(k, i, float(rng.randint(0, 2))) for k in range(2, 40) for i in range(rng.randint(1, 90))] + [(None, 1, 50.0), (99, 1, 5.0), (99, 2, None), (99, 3, 7.0)]
    df = spark.createDataFrame(rows, "source_id long, t int, score double").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # small ranges stay apart
    try:
        got = {r.source_id: (r.quality, r.runs) for r in tasks.moving_quality(df, "t").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {r.source_id: (r.quality, r.runs) for r in tasks._folded(df, "t").collect()}
    assert got == want and len(want) == 41 and want[99] == (None, 3)
    wide = df.withColumn("score", F.col("score") * 1e6)
    assert {tuple(r) for r in tasks.moving_quality(wide, "t").collect()} == {tuple(r) for r in tasks._folded(wide, "t").collect()}
    assert tasks.moving_quality(df.where("t < 0"), "t").collect() == []
