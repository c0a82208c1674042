"""Stored indexes, recursion and sketches against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import articles, trees, visits
from siftwell.sources import postings, vectors

FOLDER = "/root/testdata/sf0.001"


def ranks(df, key="doc_id"):
    return {r[key]: round(r["rank"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "中国人民 the Spark 中国"), (2, "spark, SPARK! 国人"), (3, None), (4, ""), (5, "中 国 人"), (6, "人人人人 spark2 spark"), (7, "a-b c_d 9x9")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_pairs_and_single_ideographs_rank_as_in_a_scan(spark, texts, tmp_path):
    path = str(tmp_path / "index")
    postings.refresh(texts, path)
    for keyword in ("spark", "中国", "中国人", "人", "国 spark", "人人", "人 人人", "b c", "nothing", "9x9 a", "!"):
        assert ranks(postings.search(spark, path, keyword), "key") == ranks(articles.search(texts, keyword)), keyword


def test_refresh_follows_changes_and_reads_only_the_buckets_asked_for(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "index")
    postings.refresh(docs, path)
    before = spark.read.parquet(f"{path}/postings").count()
    changed = docs.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 4, "the and of it").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(9999, "of the and")], "doc_id long, text string"))
    postings.refresh(changed, path)
    assert ranks(postings.search(spark, path, "the and of"), "key") == ranks(articles.search(changed, "the and of"))
    fresh = changed.where("doc_id % 10 = 4 OR doc_id = 9999").count() * 4 - 1
    assert spark.read.parquet(f"{path}/postings").count() == before + fresh  # 4 postings a changed text, 3 of the new one
    plan = postings.search(spark, path, "spark")._jdf.queryExecution().toString()
    assert f"bucket#" in plan and f"PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,spark)" in plan
    # postings without a commit aren't seen
    spark.read.parquet(f"{path}/live").withColumn("version", F.lit("lost")).write.mode("append").partitionBy("version").parquet(f"{path}/live")
    assert ranks(postings.search(spark, path, "the and of"), "key") == ranks(articles.search(changed, "the and of"))
    postings.refresh(changed, path)
    assert spark.read.parquet(f"{path}/postings").count() == before + fresh
    assert postings.first_of(docs.union(docs), "doc_id").count() == docs.count()


def test_fuzzy_search_through_grams_equals_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    path = str(tmp_path / "grams")
    postings.refresh(docs, path, postings=postings.gram_postings)
    for keyword in ("thatandzz", "environnement", "qq", "the", "zzzz xxxx", "über", "ing", "tion ent", "Von der", "!"):
        assert ranks(postings.fuzzy_search(docs, path, keyword)) == ranks(articles.fuzzy_search(docs, keyword)), keyword


def test_inverted_file_recall(spark, tmp_path):
    """Vectors around 40 directions: a quarter of the lists holds nine in ten of the true neighbours; all lists hold all."""
    rng = random.Random(6)
    middles = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(40)]
    rows = [(i, [float(x + rng.gauss(0, 0.7)) for x in rng.choice(middles)]) for i in range(4000)]
    df = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 32), (9002, rows[0][1])], "vec_id long, embedding array<float>").repartition(4)
    path = str(tmp_path / "lists")
    vectors.build(df, path, 24)
    found = total = 0
    for _, target in rows[:400:40]:
        want = {r.vec_id for r in articles.nearest_to(df, target, 10).collect()}
        found += len(want & {r.vec_id for r in vectors.search(spark, path, target, 10, 6).collect()})
        total += 10
        assert {r.vec_id for r in vectors.search(spark, path, target, 10, 24).collect()} == want
    assert found / total >= 0.9
    assert spark.read.parquet(f"{path}/lists").count() == 4001


def test_deep_trees_and_cycles(spark):
    rows = [(i, i - 1 if i % 12 else None) for i in range(24)] + [(100, 102), (101, 100), (102, 101), (200, 999)]
    got = trees.deep_closure(spark.createDataFrame(rows, "id long, parent_id long")).collect()
    tree = {(r.ancestor, r.descendant, r.distance) for r in got if not r.cycle and r.descendant < 100}
    assert tree == {(i - k, i, k) for i in range(24) for k in range(i % 12 + 1)}
    assert {(r.ancestor, r.descendant) for r in got if r.cycle} == {(100, 100), (101, 101), (102, 102)}
    assert {(r.ancestor, r.distance) for r in got if r.descendant == 200} == {(200, 0), (999, 1)}
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
        trees.deep_closure(spark.createDataFrame(rows, "id long, parent_id long"), 5).collect()


def test_rows_of_a_deep_closure_are_not_limited(spark):
    """1.3 million rows, where a recursion in SQL ends at a million."""
    nodes = spark.range(200_000).selectExpr("id", "CASE WHEN id % 12 <> 0 THEN id - 1 END AS parent_id")
    got = trees.deep_closure(nodes)
    assert {r.distance: r["count"] for r in got.groupBy("distance").count().collect()} == {k: sum(1 for i in range(200_000) if i % 12 >= k) for k in range(12)}
    assert got.where("cycle OR ancestor <> descendant - distance").count() == 0


def test_sketches_merge_over_days(spark):
    log = spark.range(60000).selectExpr("id % 7 AS article_id", "pmod(xxhash64(id), 20000) AS visitor_id", "timestamp_seconds(id * 30) AS visit_time")
    days = visits.daily_sketches(log, "article_id")
    for first, last in (("1970-01-01", "1970-01-21"), ("1970-01-03", "1970-01-09")):
        part = log.where(F.to_date("visit_time").between(first, last))
        want = {r.article_id: (r.uv, r.pv) for r in part.groupBy("article_id").agg(F.countDistinct("visitor_id").alias("uv"), F.count("*").alias("pv")).collect()}
        for r in visits.visitors_between(days, first, last, "article_id").collect():
            assert r.pv == want[r.article_id][1] and abs(r.uv - want[r.article_id][0]) <= 0.02 * want[r.article_id][0]
    assert abs(visits.visitors_between(days, "1970-01-01", "1970-12-31").first().uv - log.select("visitor_id").distinct().count()) <= 400
