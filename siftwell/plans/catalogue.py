"""All queries of the engine by name, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keywords, pages, quality, similarity, text, urls
from ..functions import values as V
from ..operators import articles, coverage, dedup, digest, lists, segment, strategy, tasks, trees, visits
from ..sources import postings, vectors
from ..sources.readers import table
from ..sources.stored import new_folder, spread, stored
from . import views as W

#: The year, the day and the time that count as now.
YEAR, TODAY, NOW = 2025, "2024-01-15", "1998-01-01 00:00:00"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _md5(c):
    return F.md5(c.cast("binary"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _own_counts(spark, d):
    return articles.published(W.articles(spark, d).withColumn("is_deleted", F.lit(False))).groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))


# Addresses


@query
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query
def url_hash(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_hash(F.col("url")).alias("hash"))


@query
def url_exclusion(spark, d):
    return table(spark, d, "pages").select("page_id", urls.netloc(F.col("url")).alias("host"), urls.is_excluded(F.concat("url", F.when(F.col("page_id") % 5 == 0, "/login").otherwise("")).alias("u")).alias("excluded"))


@query
def url_dedup_first(spark, d):
    return dedup.first_by_url(table(spark, d, "pages").select("page_id", "url"), F.col("page_id")).select("page_id", "url")


@query
def domain_cap(spark, d):
    return dedup.cap_per_domain(table(spark, d, "pages").select("page_id", "url"), 2, F.col("page_id"))


@query
def source_authority(spark, d):
    u = F.concat(F.when(F.col("page_id") % 4 == 0, "https://docs.python.org/").when(F.col("page_id") % 4 == 1, "https://me.github.io/").when(F.col("page_id") % 4 == 2, "https://www.youtube.com/").otherwise(""), F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.authority_score(u).cast("int").alias("score"), urls.authority_level(u).alias("level"))


@query
def infer_category(spark, d):
    return W.pages(spark, d).select("page_id", urls.infer_category(F.col("url"), F.col("title")).alias("category"))


@query
def source_name(spark, d):
    return table(spark, d, "pages").select("page_id", urls.source_name(F.when(F.col("page_id") % 3 == 0, F.lit("https://x.github.com/a")).otherwise(F.col("url"))).alias("source_name"))


# Texts


@query
def word_count(spark, d):
    return _docs(spark, d).select("doc_id", text.count_words(F.col("text")).cast("long").alias("words"), text.has_cjk(F.col("text")).alias("cjk"))


@query
def reading_time(spark, d):
    return _docs(spark, d).select("doc_id", text.visible_chars(F.col("text")).cast("long").alias("chars"), text.reading_minutes(F.col("text")).cast("long").alias("minutes"))


@query
def md_to_text_summary(spark, d):
    return _docs(spark, d).select("doc_id", text.summary(F.col("text"), 200).alias("summary"), _md5(text.markdown_to_text(F.col("text"))).alias("text_md5"))


@query
def boilerplate_filter(spark, d):
    kept = text.drop_boilerplate(F.concat(F.lit("Subscribe to our newsletter\n"), F.col("text"), F.lit("\n版权声明：本文\nend")))
    return _docs(spark, d).select("doc_id", F.length(kept).cast("long").alias("kept_chars"), _md5(kept).alias("kept_md5"))


@query
def keyword_exclusion(spark, d):
    return _docs(spark, d).select("doc_id", text.contains_any(F.col("text"), ("the and", "von der", "que de")).alias("excluded"))


@query
def page_title_lang(spark, d):
    return W.pages(spark, d).select("page_id", "title", "lang", F.length("content").cast("long").alias("content_chars"))


@query
def page_link_density(spark, d):
    items = F.aggregate(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(2)), F.lit(""), lambda a, x: F.concat(a, F.lit("["), x, F.lit("](u) ")))
    md = F.concat(items, F.substring("content", 1, 300))
    return W.pages(spark, d).select("page_id", F.round(text.link_text_ratio(md), 6).alias("ratio"))


# Pages: types and quality


@query
def page_classify(spark, d):
    p = W.pages(spark, d).withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.col("url"), F.lit("/forum-1"))).otherwise(F.col("url"))).withColumn("content", F.concat("content", F.when(F.col("page_id") % 3 == 0, " 楼主").otherwise("")))
    c = p.select("page_id", pages.classify(F.col("content"), F.col("url"), F.col("title")).alias("c"))
    return c.select("page_id", "c.page_type", F.round("c.confidence", 4).alias("confidence"))


def _scored(spark, d, digest_mode=False):
    p = W.pages(spark, d)
    score = quality.quality_score(F.col("title"), F.col("content"), F.col("url"), YEAR, digest_mode)
    return p.select("page_id", "lang", "url", F.round(score, 4).alias("score"), quality.has_paywall(F.col("content")).alias("paywall"), urls.authority_score(F.col("url")).alias("authority"))


@query
def quality_score(spark, d):
    return _scored(spark, d).select("page_id", "score", "paywall", quality.recommendation(F.col("score"), F.col("paywall")).alias("recommendation"))


@query
def quality_verdict_by_lang(spark, d):
    return _scored(spark, d).withColumn("verdict", quality.recommendation(F.col("score"), F.col("paywall"))).groupBy("lang", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query
def freshness(spark, d):
    u = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/2024/").when(F.col("page_id") % 3 == 1, "/2019/").otherwise(""))
    return W.pages(spark, d).select("page_id", quality.freshness_bonus(u, F.col("content"), YEAR).cast("long").alias("bonus"))


def _cascade_pages(spark, d):
    p = W.pages(spark, d)
    content = F.when(F.col("page_id") % 11 == 0, F.substring("content", 1, 40)).when(F.col("page_id") % 7 == 0, F.concat("content", F.lit(" 楼主"))).otherwise(F.col("content"))
    u = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/forum-1"))).when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/login"))).otherwise(F.col("url"))
    return p.select((F.col("page_id") % 9).alias("task_id"), F.col("page_id").alias("position"), u.alias("url"), "title", content.alias("content"), (F.col("page_id") % 13 != 0).alias("success"))


@query
def filter_cascade_digest(spark, d):
    return dedup.cascade(_cascade_pages(spark, d), "digest", YEAR).select("task_id", "position", "reason")


@query
def filter_cascade_stats(spark, d):
    return dedup.cascade_counts(dedup.cascade(_cascade_pages(spark, d), "digest", YEAR), "task_id")


@query
def filter_cascade(spark, d):
    return dedup.cascade(_cascade_pages(spark, d), "keyword", YEAR).select("task_id", "position", "reason")


@query
def content_verdict(spark, d):
    e = quality.evaluate(W.pages(spark, d), YEAR)
    return e.select("page_id", F.col("authority").cast("int").alias("authority"), "level", F.round("quality", 1).alias("quality"), F.round("final_score", 1).alias("final_score"), "verdict")


@query
def passing_pages(spark, d):
    good, other = quality.split_by_verdict(quality.evaluate(W.pages(spark, d), YEAR))
    count = lambda x, name: x.groupBy("lang").agg(F.count("*").alias(name))
    return count(good, "passed").join(count(other, "rejected"), "lang", "full").select("lang", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


# Duplicates


def _prints(spark, d):
    part = _docs(spark, d).select(F.col("doc_id").alias("id"), similarity.preview(F.col("text")).alias("t"))
    return stored(part.select("id", similarity.simhash(F.col("t")).alias("h")))


@query
def simhash(spark, d):
    return _docs(spark, d).select("doc_id", similarity.simhash(F.col("text")).alias("simhash"))


@query
def simhash_pairs_t3(spark, d):
    return dedup.near_pairs(_prints(spark, d).where("h <> 0"), 3).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query
def simhash_pairs_t5(spark, d):
    return dedup.near_pairs(_prints(spark, d).where("h <> 0"), 5).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query
def simhash_pairs_t12(spark, d):
    return dedup.near_pairs(_prints(spark, d).where("h <> 0"), 12).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query
def simhash_classes(spark, d):
    return dedup.print_classes(_prints(spark, d))


def _judged(spark, d):
    """Documents that have labels, as what was collected before, and all others."""
    docs = _prints(spark, d).withColumn("url", F.concat(F.lit("http://h/"), "id"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(labels, "id", "left_anti"), docs.join(labels, "id", "left_semi")


@query
def history_anti(spark, d):
    new, old = _judged(spark, d)
    return dedup.not_in_history(new, old).select("id")


@query
def history_semi(spark, d):
    new, old = _judged(spark, d)
    return dedup.close_prints(old.where("h <> 0"), new.where("h <> 0"), dedup.WITHIN).select(F.col("q").alias("h")).distinct().join(new, "h").select("id")


@query
def exact_dup_groups(spark, d):
    return lists.same_content(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "text")


@query
def greedy_dedup(spark, d):
    """All documents are one group; those of one source and length count as one address."""
    df = _docs(spark, d).select("doc_id", F.concat(F.lit("http://"), "source", F.lit("/"), "n_chars").alias("url"), F.col("text").alias("content"))
    return dedup.greedy(df, [], "doc_id", title=None).select("doc_id", "reason")


@query
def greedy_pages(spark, d):
    """All pages are one group, told by address, text and title."""
    return dedup.greedy(W.pages(spark, d), [], "page_id").select("page_id", "reason")


@query
def digest_sections_dedup(spark, d):
    """All pages are one digest with a section for each language."""
    p = W.pages(spark, d).select(F.lit(1).alias("task_id"), "lang", F.col("page_id").alias("position"), "url", "title", "content", F.lit(True).alias("success"))
    return dedup.across_sections(p, section="lang").select("task_id", "lang", "position")


@query
def title_pairs(spark, d):
    return dedup.similar_titles(W.pages(spark, d).select(F.col("page_id").alias("id"), "title")).select("a", "b", F.round("similarity", 6).alias("similarity"))


# Visits


@query
def pv_uv_per_article(spark, d):
    return visits.totals(W.visits(spark, d), TODAY)


@query
def site_uv(spark, d):
    return visits.site(W.visits(spark, d))


@query
def visitors_from_sketches(spark, d):
    """Visitors of each type of event over a month, merged from daily sketches, beside the exact number."""
    log = table(spark, d, "events").select("event_type", F.col("user_id").alias("visitor_id"), F.col("ts").alias("visit_time"))
    told = visits.visitors_between(stored(visits.daily_sketches(log, "event_type")), "2024-01-01", "2024-01-31", "event_type")
    days = log.where(F.to_date("visit_time").between(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")))
    exact = days.groupBy("event_type").agg(F.countDistinct("visitor_id").alias("exact"))
    return told.join(exact, "event_type").select("event_type", "pv", "exact", (F.abs(F.col("uv") - F.col("exact")) <= F.greatest(F.lit(1), 0.02 * F.col("exact"))).alias("close"))


@query
def visitor_state(spark, d):
    s = visits.visitor_state(W.visits(spark, d))
    return s.select("article_id", "visitor_id", F.date_format("first_view", "yyyy-MM-dd HH:mm:ss").alias("first_view"), F.date_format("last_view", "yyyy-MM-dd HH:mm:ss").alias("last_view"), "views")


@query
def visits_zero_filled(spark, d):
    ids = spark.range(0, 200).select(F.col("id").alias("article_id"))
    return visits.with_zero(ids, W.visits(spark, d).groupBy("article_id").agg(F.count("*").alias("pv")), "article_id")


@query
def visits_per_minute(spark, d):
    w = visits.per_window(W.visits(spark, d), 60, "visitor_id", "visit_time")
    return w.select("visitor_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query
def rate_limit_fixed_window(spark, d):
    r = W.visits(spark, d).select(F.col("event_id").alias("id"), (F.col("visitor_id") % 7).alias("ip"), F.col("visit_time").alias("ts"))
    return visits.rate_limited(r, 3, 3600).select("id", "ip", "allowed")


# Articles


@query
def archive_ym(spark, d):
    a = W.articles(spark, d)
    return visits.by_period(a.where("status = 1"))


@query
def top_articles(spark, d):
    return articles.top(W.articles(spark, d).where("status = 1"), 10, F.desc("is_top"), F.desc("view_count"), F.asc("id")).select("id", "view_count", "is_top")


@query
def hot_articles(spark, d):
    return articles.top(W.articles(spark, d).where("status = 1"), 10, F.desc("view_count"), F.desc("publish_time"), F.asc("id")).select("id", "view_count")


@query
def latest_articles(spark, d):
    return articles.top(W.articles(spark, d).where("status = 1"), 10, F.desc("publish_time"), F.asc("id")).select("id", dates.month(F.col("publish_time")).alias("month"))


@query
def article_page(spark, d):
    return articles.page(W.articles(spark, d).where("status = 1"), articles.sort_order("popular"), 3, 20).select("id", "view_count")


@query
def page_with_total(spark, d):
    return articles.page_info(W.articles(spark, d).where("status = 1"), 20)


@query
def article_enriched(spark, d):
    counts = W.visits(spark, d).groupBy("article_id").agg(F.count("*").alias("pv"), F.countDistinct("visitor_id").alias("uv"))
    return articles.enriched(W.articles(spark, d), W.categories(spark, d), counts)


@query
def dashboard_totals(spark, d):
    return articles.dashboard(W.articles(spark, d), table(spark, d, "part"), W.visits(spark, d))


@query
def status_distribution(spark, d):
    return articles.status_distribution(W.articles(spark, d), W.categories(spark, d))


@query
def related_logs(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("mood"), (F.col("user_id") % 5).alias("category_id"), F.to_date("ts").alias("log_date"))
    return articles.related_logs(e).select("id", "other", F.col("score").cast("long").alias("score"))


@query
def related_articles(spark, d):
    return articles.related_articles(W.articles(spark, d).where("status = 1"), 3)


@query
def fts_search(spark, d):
    return articles.search(_docs(spark, d), "the and of").select("doc_id", F.round("rank", 6).alias("rank"))


@query
def fts_indexed(spark, d):
    """The same search through a stored index, which was built of half of the documents and then brought up to date."""
    docs, path = _docs(spark, d).select("doc_id", "text"), new_folder(spark)
    postings.refresh(docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, "the and of old text").otherwise(F.col("text"))), path)
    postings.refresh(docs, path)
    return postings.search(spark, path, "the and of").select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query
def fuzzy_grams(spark, d):
    """The trigrams of a misspelt keyword that documents hold, from a stored index of trigrams."""
    path = new_folder(spark)
    postings.refresh(_docs(spark, d).select("doc_id", "text"), path, postings=postings.gram_postings)
    return postings.grams_shared(spark, path, "thatandzz").select(F.col("key").alias("doc_id"), F.round("share", 6).alias("share"))


@query
def fuzzy_indexed(spark, d):
    docs, path = _docs(spark, d).select("doc_id", "text"), new_folder(spark)
    postings.refresh(docs, path, postings=postings.gram_postings)
    return postings.fuzzy_search(docs, path, "thatandzz").select("doc_id", F.round("rank", 6).alias("rank"))


@query
def search_order(spark, d):
    """The first page of a public search over all documents, in the order that readers see."""
    a = _docs(spark, d).select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("content"), F.lit(1).alias("status"), (F.col("doc_id") % 50 == 0).alias("is_top"),
        F.timestamp_seconds(F.col("n_chars") * 3600).alias("publish_time"), (F.col("doc_id") % 25).alias("category_id"), F.col("n_chars").alias("view_count"),
    )
    found = articles.search_articles(a, W.categories(spark, d), "the and")
    return found.limit(50).select(F.monotonically_increasing_id().alias("place"), "id", F.round("rank", 6).alias("rank"))


@query
def vector_lists(spark, d):
    """The ten nearest through an inverted file of which a search reads all lists: equal to the scan."""
    path, target = new_folder(spark), [1.0 if i % 2 else -0.5 for i in range(64)]
    vectors.build(table(spark, d, "embeddings").select("vec_id", "embedding"), path, 16)
    return vectors.search(spark, path, target, 10, 16).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def fts_with_fallback(spark, d):
    return articles.search_with_fallback(_docs(spark, d), "thatandzz").select("doc_id", F.round("rank", 6).alias("rank"))


@query
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    target = [1.0 if i % 2 else -0.5 for i in range(64)]
    return articles.nearest_to(e, target, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


# Category tree


@query
def category_closure(spark, d):
    return trees.closure(W.categories(spark, d))


@query
def deep_closure(spark, d):
    """Chains of twelve levels."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 12 != 0, F.col("p_partkey") - 1).alias("parent_id"))
    return trees.deep_closure(p.where("id >= 12")).select("ancestor", "descendant", "distance", "cycle")


@query
def category_counts(spark, d):
    return _own_counts(spark, d)


@query
def category_rollup_live(spark, d):
    return trees.rollup_all(W.categories(spark, d), _own_counts(spark, d))


@query
def category_rollup_leaf(spark, d):
    return trees.rollup_leaves(W.categories(spark, d), _own_counts(spark, d))


@query
def category_path(spark, d):
    return trees.paths(W.categories(spark, d))


@query
def category_children(spark, d):
    return trees.nested(W.categories(spark, d)).select("id", "name", F.array_join("children.name", ",").alias("children"))


@query
def count_drift(spark, d):
    stored = W.categories(spark, d).where("parent_id is not null").select("id", (F.col("id") * 10).alias("article_count"))
    return trees.drift(stored, _own_counts(spark, d))


# Tasks and rounds


@query
def task_stats(spark, d):
    return tasks.stats(W.tasks(spark, d))


@query
def stale_tasks(spark, d):
    return tasks.stale(W.tasks(spark, d), NOW).select("id", "status")


@query
def crawl_summary(spark, d):
    li = table(spark, d, "lineitem")
    return tasks.crawl_summary(li.select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") == "N").alias("success"), F.floor("l_extendedprice").alias("crawl_ms"), F.col("l_quantity").alias("word_count")))


def _effect(df):
    return [F.round(c, 6).alias(c) if c in ("avg_delta", "avg_score", "max_delta") else F.col(c) for c in df.columns]


@query
def engine_effectiveness(spark, d):
    e = tasks.effectiveness(W.rounds(spark, d), "search_engine")
    return e.select(*_effect(e))


@query
def strategy_effectiveness(spark, d):
    e = tasks.effectiveness(W.rounds(spark, d), "strategy_type", gains_only=True)
    return e.select(*_effect(e))


@query
def kb_stats(spark, d):
    s = tasks.knowledge_stats(W.rounds(spark, d))
    return s.select("tasks", "rounds", "improved", F.round("avg_delta", 6).alias("avg_delta"), "improvement_rate")


@query
def strategy_hint(spark, d):
    h = tasks.hint(W.rounds(spark, d), "part 1", "week")
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), F.format_number(x["mean_delta"], 4))), ",").alias(c)
    return h.select("engine", flat("engine_scores"), "strategy_type", flat("type_scores"), F.array_join("related_keywords", ",").alias("related_keywords"))


@query
def effective_strategies(spark, d):
    return tasks.effective(W.rounds(spark, d)).select("id", "search_engine", F.round("score_delta", 6).alias("score_delta"))


@query
def round_delta(spark, d):
    return tasks.deltas(W.rounds(spark, d), "overall_score").select("task_id", "round_num", "delta")


def _runs(spark, d):
    return W.visits(spark, d).select(F.col("visitor_id").alias("source_id"), "visit_time", "event_id", F.col("value").alias("score"), (F.col("event_type") != "error").alias("ok"))


@query
def source_ema(spark, d):
    return tasks.moving_quality(_runs(spark, d).where("ok"), "visit_time", "event_id")


@query
def source_counters(spark, d):
    return tasks.run_counters(_runs(spark, d), "visit_time", "event_id")


@query
def source_effectiveness(spark, d):
    s = _runs(spark, d).groupBy("source_id").agg(F.count("*").alias("run_count"), F.count_if("ok").alias("success_count"), F.max("score").alias("avg_quality_score"))
    return tasks.section_effectiveness(s.withColumn("section", F.col("source_id") % 9))


@query
def sections_from_sources(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 5 == 0, None).otherwise(F.concat(F.lit("c"), F.col("s_nationkey") % 5)).alias("category"),
        F.when(F.col("s_suppkey") % 3 == 0, "url").when(F.col("s_suppkey") % 7 == 0, "rss").when(F.col("s_suppkey") % 11 == 0, "other").when(F.col("s_suppkey") % 13 == 0, None).otherwise("keyword").alias("type"),
        F.col("s_name").alias("value"), F.col("s_nationkey").alias("max_pages"), (F.col("s_suppkey") * 7).alias("freshness_hours"),
    )
    return tasks.sections(s).select("name", "source_type", "max_items", F.md5(F.col("keyword").cast("binary")).alias("keyword_md5"), "time_range", F.array_join("urls", ",").alias("urls"), F.size("feeds").cast("long").alias("feeds"))


@query
def crawl_bfs(spark, d):
    li = table(spark, d, "lineitem")
    links = li.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).union(li.where("l_linenumber = 1").select(F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))))
    seeds = spark.createDataFrame([("p1",)], "url string")
    return tasks.crawl(links, seeds, 3, 500).select("url", F.col("depth").cast("long").alias("depth"), F.col("position").cast("long").alias("position"))


# Coverage


@query
def shannon_diversity(spark, d):
    return coverage.diversity(_docs(spark, d).withColumn("g", F.col("doc_id") % 7), "g", "source").select("g", F.round("diversity", 6).alias("diversity"))


def _results(spark, d):
    return W.pages(spark, d).select((F.col("page_id") % 12).alias("g"), urls.domain(F.col("url")).alias("domain"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("推荐 best "), F.col("title"))).otherwise(F.col("title")).alias("title"), "content")


@query
def language_mix(spark, d):
    g = _results(spark, d).groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("title").rlike(text.CJK)).alias("c"), F.count_if(F.col("title").rlike("[a-zA-Z]{3,}")).alias("l"))
    return g.select("g", F.round(coverage.language_mix(F.col("n"), F.col("c"), F.col("l")), 2).alias("mix"))


@query
def coverage_overall(spark, d):
    e = coverage.direction_scores(coverage.evaluate(_results(spark, d), "g"))
    wide = [F.round(c, 4).alias(c) for c in ("diversity", "language", "depth", "temporal", "overall", "depth_score", "breadth_score")]
    return e.select("g", "n", "sources", F.round("angle", 2).alias("angle"), F.round("perspective", 2).alias("perspective"), *wide, "weaknesses", "suggestions")


# Digests


def _items(spark, d):
    return table(spark, d, "pages").select((F.col("page_id") % 7).alias("section"), F.col("page_id").alias("position"), F.regexp_replace("url", "/[0-9].*$", "").alias("url"), F.substring("html", 100, (F.col("page_id") % 9).cast("int")).alias("one_liner"))


@query
def digest_item_dedup(spark, d):
    return digest.distinct_items(_items(spark, d)).select("section", "position", "url")


@query
def url_repair(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 7).alias("task_id"), F.col("page_id").alias("position"), "url")
    broken = F.when(F.col("position") % 4 == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("position") % 4 == 1, F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/$", "")).when(F.col("position") % 4 == 2, F.concat("url", F.lit("zz"))).otherwise(F.col("url"))
    return digest.repair_urls(p.withColumn("url", broken), p.select("task_id", "url")).select("task_id", "position", "fixed")


@query
def digest_pack(spark, d):
    p = W.pages(spark, d).select(F.floor(F.col("page_id") / 20).alias("task_id"), "page_id", F.regexp_replace("content", " ", "").alias("content"))
    return digest.pack(p, 20_000, 4_000).select("task_id", "page_id", F.coalesce(F.length("packed"), F.lit(0)).cast("long").alias("packed_chars"))


@query
def digest_prompt(spark, d):
    p = W.pages(spark, d)
    names = F.array(*map(F.lit, ["hot_trend", "paper", "", "other"]))
    rows = p.select(
        F.floor(F.col("page_id") / 20).alias("task_id"), "page_id", F.element_at(names, (F.col("page_id") % 4 + 1).cast("int")).alias("category"), urls.authority_level(F.col("url")).alias("source_level"),
        "title", F.when(F.col("page_id") % 2 == 0, F.substring("content", 1, 80)).alias("summary"), "content",
    )
    return digest.pack_digest(rows, 40_000, 2_000).select("task_id", "category", "place", "page_id", "mode", F.length("packed").cast("long").alias("packed_chars"))


# Lists


@query
def url_window(spark, d):
    p = table(spark, d, "events").select(F.md5((F.col("user_id") % 97).cast("string").cast("binary")).alias("url_hash"), F.col("ts").alias("created_at"))
    h = spark.range(0, 120).select(F.md5(F.col("id").cast("string").cast("binary")).alias("url_hash"))
    return lists.seen_lately(p, h, "2024-01-20 00:00:00", 5)


@query
def usable_results(spark, d):
    r = W.pages(spark, d).select(F.col("page_id").alias("position"), F.regexp_replace("url", "[?#].*$", "").alias("url"), (F.col("page_id") % 6 != 0).alias("success"), "content")
    seen = W.pages(spark, d).where("lang = 'es'").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()
    return lists.usable_results(r, seen, 300, 50).select("position", "url")


@query
def log_stats(spark, d):
    return lists.log_stats(table(spark, d, "orders").select(F.floor("o_totalprice").alias("word_count"), F.to_date("o_orderdate").alias("log_date")))


@query
def logs_by_month(spark, d):
    return lists.by_month(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("log_date")))


@query
def engine_health(spark, d):
    return lists.engine_health(table(spark, d, "events").select(F.col("event_type").alias("engine"), F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 4).alias("results")))


@query
def similar_keyword_rounds(spark, d):
    return lists.similar_keyword_rounds(W.rounds(spark, d), "11 22 33", 10).select("id", "search_keyword", F.round("score_delta", 6).alias("score_delta"))


@query
def answer_category(spark, d):
    c = F.element_at(F.array(*map(F.lit, ["Backend", "ai", "DevOps", "cooking", " security ", ""])), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", lists.aliased(c, V.CATEGORY_ALIASES, V.ALLOWED_CATEGORIES).alias("category"))


@query
def keyword_relevance(spark, d):
    return W.pages(spark, d).select("page_id", keywords.is_relevant("the and", F.col("title"), F.substring("content", 1, 80)).alias("relevant"))


@query
def titles_without_blanks(spark, d):
    """Titles of pages, written without blanks, split into the words that the whole table teaches."""
    p = W.pages(spark, d).select("page_id", F.translate(F.lower("title"), " ", "").alias("text"))
    how = {"pattern": "[a-zà-ÿ]+"}
    split = segment.words(p, segment.learn(p, longest=6, **how), others="[0-9]+", **how)
    return split.select("page_id", F.size("words").cast("long").alias("n"), F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"))


@query
def section_overrides(spark, d):
    s = _runs(spark, d).groupBy("source_id").agg(F.count("*").alias("total_runs"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("score").alias("avg_quality"))
    return strategy.overrides(s.withColumn("dead", F.col("source_id") % 5 == 0)).select("source_id", "freshness_multiplier", "items_multiplier")


@query
def stop_rule(spark, d):
    r = W.rounds(spark, d).groupBy("task_id", "round_num").agg(F.max("overall_score").alias("overall_score"))
    return strategy.should_stop(r, 0.9)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by language and verdict: address, title, text, type and quality in one pass over the table."""
    return quality_verdict_by_lang(spark, sf_dir)


from . import entities  # noqa: E402
from .oracles import ORACLE_SQL as _OWN_SQL  # noqa: E402

QUERIES |= entities.QUERIES
ORACLE_SQL = _OWN_SQL | entities.ORACLE_SQL
