"""Queries over the entities of a site and its collector (tasks, digests, files, settings, feeds, metadata), each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, keywords, text, urls
from ..functions import schedules as cron
from ..functions import values as V
from ..operators import articles, dedup, digest, lists, strategy, tasks, trees
from ..sources import readers
from ..sources.readers import table
from . import views as W
from .views import sql as over

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def pick(key: str, *values):
    """One of some values, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


# Tables and settings


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 5")
def point_lookup(spark, d):
    return readers.lookup(table(spark, d, "customer"), c_custkey=5).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def existing_keys(spark, d):
    return readers.existing(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F')")
def live_rows(spark, d):
    return readers.live(table(spark, d, "orders").withColumn("is_deleted", F.col("o_orderstatus") == "F")).select(F.col("o_orderkey").alias("id"))


@query("SELECT 'key' || p_partkey AS config_key, p_name AS config_value FROM part WHERE p_size % 2 = 0 AND p_brand = 'Brand#11'")
def public_settings(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("key"), "p_partkey").alias("config_key"), F.col("p_name").alias("config_value"), F.col("p_brand").alias("config_group"), (F.col("p_size") % 2 == 0).alias("is_public"))
    return lists.settings_of(p, "Brand#11", public=True)


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN s_name || ':url:' || s_nationkey || ',n' || s_nationkey || ':rss:' WHEN 1 THEN 'usual:keyword:spark' WHEN 2 THEN 'usual:keyword:spark' ELSE s_name || ':url:' || s_nationkey END AS sections FROM supplier""")
def section_settings(spark, d):
    """Settings made of suppliers: two sections, an empty list, a broken one, one section and an object without a name."""
    one, two = F.struct(F.col("s_name").alias("name"), F.lit("url").alias("source_type"), F.col("s_nationkey").cast("string").alias("keyword")), F.struct(F.concat(F.lit("n"), "s_nationkey").alias("name"), F.lit("rss").alias("source_type"), F.lit("").alias("keyword"))
    whole, k = F.to_json(F.array(one, two)), F.col("s_suppkey") % 4
    config = F.when(k == 0, whole).when(k == 1, "[]").when(k == 2, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(F.concat(F.substring(F.to_json(F.array(one)), F.lit(1), F.length(F.to_json(F.array(one))) - 1), F.lit(', {"keyword": "x"}]')))
    found = readers.sections_of(config, [("usual", "keyword", "spark")])
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x["source_type"], x["keyword"])), ",").alias("sections"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS dom FROM pages), k AS (SELECT dom, max(CASE WHEN page_id % 3 <> 0 THEN 10 + page_id % 80 END) AS score FROM p GROUP BY 1)
    SELECT page_id, dom AS domain, coalesce(score, -1) AS score FROM p JOIN k USING (dom)""")
def authority_table(spark, d):
    p = table(spark, d, "pages")
    known = p.select(urls.domain(F.col("url")).alias("domain"), (F.col("page_id") % 80 + 10).cast("int").alias("score"), F.lit("high").alias("level"), (F.col("page_id") % 3 != 0).alias("is_active"), F.lit(False).alias("is_deleted"))
    r = urls.rated(p, "url", known).withColumn("own", urls.authority_score(F.col("url")))
    told = known.where("is_active").select(F.col("domain").alias("d")).distinct()
    return r.join(told, urls.domain(F.col("url")) == F.col("d"), "left").select("page_id", urls.domain(F.col("url")).alias("domain"), F.when(F.col("d").isNotNull(), F.col("authority")).otherwise(F.when(F.col("authority") == F.col("own"), -1).otherwise(-2)).cast("long").alias("score"))


# Tasks


def _tasks(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("user_id"), F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "F", 4).otherwise(1).alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "digest").when(F.col("o_orderpriority") == "2-HIGH", "deep").otherwise("single").alias("task_type"),
        F.concat(F.lit("http://www.h"), F.col("o_custkey") % 17, F.lit(".org/a/"), "o_orderkey").alias("source_url"), F.concat(F.lit("kw "), "o_custkey").alias("keyword"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("py-"), "o_orderkey")).alias("external_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("digest_date"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("title "), "o_orderkey")).alias("ai_title"), F.repeat(F.lit("sum "), (F.col("o_orderkey") % 90).cast("int")).alias("ai_summary"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("light "), "o_orderkey")).alias("digest_highlight"), (F.col("o_orderkey") % 7).alias("completed_pages"), (F.col("o_orderkey") % 9).alias("total_pages"),
        F.floor("o_totalprice").cast("long").alias("total_word_count"),
    )


_T = """WITH t AS (SELECT o_orderkey AS id, o_custkey % 10 AS user_id, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 4 ELSE 1 END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'digest' WHEN '2-HIGH' THEN 'deep' ELSE 'single' END AS task_type,
    'http://www.h' || (o_custkey % 17) || '.org/a/' || o_orderkey AS source_url, 'kw ' || o_custkey AS keyword, o_orderdate AS made, CASE WHEN o_orderkey % 3 <> 0 THEN 'py-' || o_orderkey END AS external_id, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'title ' || o_orderkey END AS ai_title, repeat('sum ', CAST(o_orderkey % 90 AS INTEGER)) AS ai_summary, CASE WHEN o_orderkey % 5 = 0 THEN 'light ' || o_orderkey END AS light,
    o_orderkey % 7 AS done, o_orderkey % 9 AS pages, CAST(floor(o_totalprice) AS BIGINT) AS words FROM orders) """


@query(_T + "SELECT id, status FROM t WHERE user_id = 3 AND status = 3 AND task_type = 'deep' AND (contains(source_url, 'h1') OR contains(keyword, 'h1'))")
def task_filter(spark, d):
    return tasks.filtered(_tasks(spark, d), 3, "deep", "h1", 3).select("id", "status")


@query(_T + "SELECT id FROM t WHERE status IN (0, 1, 2) AND made < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 MINUTES AND external_id IS NOT NULL ORDER BY made, id LIMIT 20")
def stale_external_tasks(spark, d):
    return tasks.stale(_tasks(spark, d), "1998-01-01 00:00:00").select("id")


@query(_T + """SELECT id, CASE status WHEN 3 THEN 'done' WHEN 4 THEN 'failed' ELSE '1' END AS status_text, CASE task_type WHEN 'digest' THEN '日报' ELSE task_type END AS type_text, CAST(CASE WHEN pages > 0 THEN floor(done * 100 / pages) ELSE 0 END AS INTEGER) AS progress,
    substr(source_url, 1, 60) AS source, CASE WHEN length(ai_summary) > 200 THEN substr(ai_summary, 1, 200) || '...' ELSE ai_summary END AS summary FROM t""")
def task_labels(spark, d):
    return tasks.labelled(_tasks(spark, d), {3: "done", 4: "failed"}, {"digest": "日报"})


@query(_T + "SELECT id, day AS digest_date FROM t WHERE task_type = 'digest' AND status = 3 AND ai_title IS NOT NULL ORDER BY day DESC, id DESC LIMIT 1")
def newest_digest(spark, d):
    return lists.latest_digest(_tasks(spark, d)).select("id", "digest_date")


@query(_T + "SELECT day AS digest_date, light AS digest_highlight FROM t WHERE task_type = 'digest' AND light IS NOT NULL ORDER BY day DESC, id DESC LIMIT 5")
def recent_highlights(spark, d):
    return lists.highlights(_tasks(spark, d), 5)


@query(_T + "SELECT id FROM t WHERE task_type = 'digest' AND day = '1996-07-25' AND status <> 4")
def digest_of_day(spark, d):
    return lists.digest_open(_tasks(spark, d), "1996-07-25").select("id")


def _task_pages(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("sort_order"), F.concat(F.lit("http://p/"), "l_partkey").alias("url"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("part "), "l_partkey")).alias("page_title"), F.concat(F.lit("text "), "l_suppkey").alias("raw_markdown"), F.when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("crawl_status"),
    )


_P = _T + """, p AS (SELECT l_orderkey AS task_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS k, 'http://p/' || l_partkey AS url, CASE WHEN l_linenumber % 3 <> 0 THEN 'part ' || l_partkey END AS title, 'text ' || l_suppkey AS md,
    CASE l_returnflag WHEN 'N' THEN 1 ELSE 2 END AS crawl FROM lineitem) """


@query(_P + "SELECT task_id, url, title AS page_title, substr(md, 1, 6) AS head FROM p WHERE task_id IN (SELECT id FROM t WHERE task_type = 'digest' AND status = 3 ORDER BY id DESC LIMIT 3)")
def history_of_digests(spark, d):
    return lists.history_pages(_tasks(spark, d), _task_pages(spark, d), 3, 6)


@query(_P + "SELECT id, row_number() OVER (PARTITION BY task_id ORDER BY k, id) AS place FROM p")
def pages_in_order(spark, d):
    return lists.in_order(_task_pages(spark, d), "task_id", "sort_order").select("id", "place")


@query(_P + """, b AS (SELECT task_id, string_agg(md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k, md) AS body FROM p GROUP BY 1) SELECT id, md5('> ' || source_url || chr(10) || '> a, b' || coalesce(chr(10) || chr(10) || coalesce(CASE WHEN id % 2 = 0 THEN ai_title END, body), '')) AS document_md5 FROM t LEFT JOIN b ON id = task_id""")
def task_documents(spark, d):
    t = _tasks(spark, d).withColumn("ai_tags", F.array(F.lit("a"), F.lit("b"))).withColumn("ai_full_content", F.when(F.col("id") % 2 == 0, F.col("ai_title")))
    return lists.task_document(t, _task_pages(spark, d)).select("id", F.md5(F.coalesce("document", F.lit("")).cast("binary")).alias("document_md5"))


@query(_P + """, b AS (SELECT task_id, count(*) AS good, string_agg('## ' || coalesce(title, url) || chr(10) || '> 来源: ' || url || chr(10) || chr(10) || md || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY k, url, md) AS body FROM p WHERE crawl = 1 GROUP BY 1)
    SELECT id, md5('# 爬取任务 #' || id || ' - ' || CASE task_type WHEN 'digest' THEN '日报' ELSE task_type END || chr(10) || chr(10) || '> URL: ' || source_url || chr(10) || '> 关键词: ' || keyword || chr(10) || '> 完成时间: ' || day || chr(10)
    || '> 成功页面: ' || coalesce(good, 0) || '/' || pages || chr(10) || '> 总字数: ' || words || chr(10) || chr(10) || '---' || chr(10) || CASE WHEN id % 2 = 0 THEN chr(10) || '## AI 整理' || CASE WHEN ai_title IS NULL THEN '结果' ELSE ': ' || ai_title END || chr(10) || CASE WHEN ai_summary <> '' THEN chr(10) || '> 摘要: ' || ai_summary ELSE '' END
    || chr(10) || '> 标签: a, b' || chr(10) || chr(10) || 'written' || chr(10) || chr(10) || '---' || chr(10) ELSE '' END || coalesce(chr(10) || body, '')) AS markdown_md5 FROM t LEFT JOIN b ON id = task_id""")
def task_export(spark, d):
    t = _tasks(spark, d).withColumn("ai_tags", F.array(F.lit("a"), F.lit("b"))).withColumn("ai_full_content", F.when(F.col("id") % 2 == 0, "written")).withColumn("updated_at", F.col("digest_date"))
    return digest.export_task(t, _task_pages(spark, d), {"digest": "日报"}).select("id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query(_P + r""", b AS (SELECT task_id, list(title ORDER BY k, title) AS titles FROM p WHERE title IS NOT NULL GROUP BY 1), c AS (SELECT id, CASE id % 3 WHEN 0 THEN '原始关键词：spark' || chr(10) || '优化关键词：spark sql' || chr(10) || '实际搜索词变体：a | b'
    WHEN 1 THEN CASE WHEN task_type = 'deep' THEN '深度爬取目标站点：' ELSE '爬取来源：' END || regexp_extract(source_url, 'www\.([^/]*)', 1) || chr(10) || CASE WHEN task_type = 'deep' THEN '起始路径：/' ELSE '页面路径：/' END || 'a/' || id || chr(10)
    || CASE WHEN task_type = 'deep' THEN '以上内容来自同一站点的多个页面，请综合分析并围绕站点主题组织内容。' ELSE '请围绕以上来源页面的实际主题组织内容，避免被页面中无关的导航、广告等噪音带偏。' END
    ELSE '页面标题：' || array_to_string(titles[1:5], ' | ') END AS c FROM t LEFT JOIN b ON id = task_id) SELECT id, md5(coalesce(c, '')) AS context_md5 FROM c""")
def task_context(spark, d):
    meta = '{"originalKeyword": "spark", "optimizedKeyword": "spark sql", "searchVariants": ["a", "b"]}'
    t = _tasks(spark, d).withColumn("ai_search_metadata", F.when(F.col("id") % 3 == 0, F.lit(meta))).withColumn("source_url", F.when(F.col("id") % 3 != 2, F.col("source_url")))
    return digest.context_lines(t, _task_pages(spark, d)).select("id", F.md5(F.coalesce("context", F.lit("")).cast("binary")).alias("context_md5"))


@query("""WITH s AS (SELECT o_custkey % 40 AS digest_id, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey ELSE '' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'keyword' ELSE 'rss' END AS kind,
    CASE o_orderkey % 4 WHEN 0 THEN 'longer words OR key OR x' WHEN 1 THEN 'a' ELSE '' END AS kw FROM orders), w AS (SELECT *, CASE WHEN kind = 'keyword' THEN CASE o4 WHEN 0 THEN 'key' WHEN 1 THEN 'a' END END AS word FROM (SELECT *, position % 4 AS o4 FROM s))
    SELECT digest_id, coalesce(arg_min(word, position) FILTER (WHERE word IS NOT NULL), arg_min(name, position) FILTER (WHERE name <> ''), 'technology') AS keyword FROM w GROUP BY 1""")
def digest_keyword(spark, d):
    s = table(spark, d, "orders").select(
        (F.col("o_custkey") % 40).alias("digest_id"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("n"), "o_orderkey")).otherwise("").alias("name"),
        F.when(F.col("o_orderkey") % 5 == 0, "keyword").otherwise("rss").alias("source_type"), pick("o_orderkey", "longer words OR key OR x", "a", "", "").alias("keyword"),
    )
    return lists.representative_keyword(s)


# Collected results


@query(r"""WITH r AS (SELECT l_orderkey AS query, CASE l_returnflag WHEN 'N' THEN 'bing' WHEN 'A' THEN 'sogou' ELSE 'google' END AS engine, 'http://u/' || (l_partkey % 50) AS url, l_linenumber AS rank, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 3 ELSE 4 END AS o FROM lineitem),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY o, rank) = 1) SELECT query, engine, url, row_number() OVER (PARTITION BY query ORDER BY o, rank, url) AS n FROM k QUALIFY n <= 3""")
def engine_fallback(spark, d):
    e = F.when(F.col("l_returnflag") == "N", "bing").when(F.col("l_returnflag") == "A", "sogou").otherwise("google")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), e.alias("engine"), F.concat(F.lit("http://u/"), F.col("l_partkey") % 50).alias("url"), F.col("l_linenumber").alias("rank"))
    return readers.merged_results(r, 3).select("query", "engine", "url", "n")


@query("SELECT l_orderkey AS task_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS search_rank FROM lineitem")
def search_rank(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("n"), "l_extendedprice")
    return lists.ranked(r, "task_id", F.desc("l_extendedprice"), F.asc("n")).select("task_id", "n", "search_rank")


@query(f"SELECT page_id, regexp_matches(lower(CASE WHEN page_id % 5 = 0 THEN replace(html, '<h1>', '<h1>' || CASE WHEN page_id % 2 = 0 THEN 'Please VERIFY you are human. ' ELSE '{keywords.ROBOT_PHRASES[0]} ' END) ELSE html END), '{text.alternation(x.lower() for x in keywords.ROBOT_PHRASES).replace(chr(39), chr(39) * 2)}') AS robot FROM pages")
def robot_pages(spark, d):
    """Whole pages, one in five with such a phrase in its heading."""
    phrase = F.when(F.col("page_id") % 2 == 0, "Please VERIFY you are human. ").otherwise(f"{keywords.ROBOT_PHRASES[0]} ")
    page = F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<h1>"), F.concat(F.lit("<h1>"), phrase))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", keywords.asks_for_human(page).alias("robot"))


@query(over("pages", "SELECT page_id, page_id % 3 <> 0 AND CAST(floor(length(regexp_replace(content, '[^一-鿿]', '', 'g')) + 1.5 * len(regexp_extract_all(content, '[a-zA-Z]+'))) AS BIGINT) >= 300 AS success FROM v_pages"))
def short_results_fail(spark, d):
    p = W.pages(spark, d).select("page_id", "content", (F.col("page_id") % 3 != 0).alias("success"))
    return lists.fail_short(p, 300).select("page_id", "success")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS digest_date FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-12'")
def fingerprints_of_days(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("digest_date"))
    return lists.recent_fingerprints(e, "2024-01-15", 3)


@query("""WITH n AS (SELECT DISTINCT md5(CAST(user_id AS VARCHAR)) AS url_hash, strftime(ts, '%Y-%m-%d') AS digest_date FROM events) SELECT * FROM n WHERE (url_hash, digest_date) NOT IN (SELECT md5(CAST(user_id AS VARCHAR)), strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'click')""")
def new_fingerprints(spark, d):
    e = table(spark, d, "events").select(F.md5(F.col("user_id").cast("string").cast("binary")).alias("url_hash"), F.date_format("ts", "yyyy-MM-dd").alias("digest_date"), "event_type")
    return dedup.append_fingerprints(e.where("event_type = 'click'").drop("event_type"), e.drop("event_type"))


@query("""WITH k AS (SELECT md5(text) AS m, min(doc_id) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
    SELECT doc_id AS id, k AS known_id FROM documents JOIN k ON md5(text) = m WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def known_files(spark, d):
    """Documents with labels are the known ones."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("md5"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return lists.known_content(docs.join(labels, "id", "left_anti"), docs.join(labels, "id", "left_semi"))


@query("""SELECT user_id AS source_id, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 6) AS mean_score FROM events GROUP BY 1""")
def source_score_means(spark, d):
    result = F.when(F.col("event_id") % 4 == 0, "{}").otherwise(F.concat(F.lit('{"quality_score": '), F.col("value").cast("string"), F.lit("}")))
    e = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "error", "success").otherwise("failed").alias("status"), result.alias("result"))
    return lists.source_scores(e).select("source_id", "ok", F.round("mean_score", 6).alias("mean_score"))


@query("WITH s AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'click') AS good, count(*) FILTER (WHERE event_type <> 'click') AS bad FROM events GROUP BY 1) SELECT id FROM s WHERE good + bad >= 3 AND good / (good + bad) < 0.2")
def sources_skipped(spark, d):
    click = F.col("event_type") == "click"
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count_if(click).alias("success_count"), F.count_if(~click).alias("fail_count"))
    return strategy.sources_to_skip(e).select("id")


@query("""SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 7 = 0 THEN -1.0 ELSE CAST(coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 97 END, 50) AS DOUBLE) END AS value FROM supplier WHERE s_nationkey <> 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def best_section(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 97).cast("double")).alias("avg_quality"), (F.col("s_suppkey") % 7 == 0).alias("dead"), "s_nationkey")
    return strategy.pick_section(s.drop("s_nationkey"), s.where("s_nationkey = 1")).select("name", "value")


# Categories, files, lists of a site


def _categories(spark, d):
    c = W.categories(spark, d)
    return c.withColumn("is_leaf", F.col("parent_id").isNotNull()).withColumn("status", F.when(F.col("id") % 4 == 0, 2).otherwise(1)).withColumn("slug", F.lower("name"))


@query(over("categories", "SELECT id FROM v_categories WHERE parent_id = 1002 AND id % 4 <> 0 AND (contains(name, 'A') OR contains(lower(name), 'A'))"))
def category_filter(spark, d):
    return lists.categories_page(_categories(spark, d), parent=1002, leaf=True, status=1, keyword="A").select("id")


@query(over("categories", "SELECT id FROM v_categories WHERE parent_id IS NOT NULL AND id % 4 <> 0"))
def leaf_categories(spark, d):
    return lists.leaves(_categories(spark, d)).select("id")


@query(over("categories closure", "SELECT descendant AS id FROM v_closure WHERE ancestor = 1003"))
def category_subtree(spark, d):
    return trees.subtree(W.categories(spark, d), 1003)


@query(over("articles categories closure", "SELECT id FROM v_articles WHERE status = 1 AND category_id IN (SELECT descendant FROM v_closure WHERE ancestor = 1001)"))
def articles_below(spark, d):
    ids = trees.subtree(W.categories(spark, d), 1001).select(F.col("id").alias("category_id"))
    return W.articles(spark, d).where("status = 1").join(ids, "category_id", "left_semi").select("id")


@query(over("categories", "SELECT i AS id, i IN (SELECT id FROM v_categories) AND i NOT IN (SELECT parent_id FROM v_categories WHERE parent_id IS NOT NULL) AS allowed FROM (SELECT unnest([1, 5, 1001, 1003, 77]) AS i)"))
def categories_for_articles(spark, d):
    return trees.may_hold_articles(W.categories(spark, d), spark.createDataFrame([(i,) for i in (1, 5, 1001, 1003, 77)], "id long"))


@query(over("categories", """SELECT p.id, p.name, '[' || string_agg('{"id":' || c.id || ',"name":["' || c.name || '"],"children":[]}', ',' ORDER BY c.id) || ']' AS tree FROM v_categories p JOIN v_categories c ON c.parent_id = p.id WHERE p.parent_id IS NULL GROUP BY 1, 2"""))
def category_tree(spark, d):
    return trees.nested_tree(W.categories(spark, d))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 < 2 AND contains(p_name, 'a') AND p_size % 3 <> 2")
def document_files(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), pick("p_size", "application/pdf", "text/plain", "image/png").alias("mime_type"))
    return lists.files_page(f, "a", "document").select("id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 3 = 1")
def visible_links(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("status"), F.col("s_suppkey").alias("sort"))
    return lists.visible(s).select("id")


def _logs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 30).cast("long").alias("category_id"), F.col("ts").alias("log_date"), (F.col("event_id") % 2 == 0).alias("is_public"))


@query(over("categories", "SELECT event_id AS id, name AS category FROM events LEFT JOIN v_categories c ON user_id % 30 = c.id"))
def logs_by_category(spark, d):
    return lists.logs_with_category(_logs(spark, d), W.categories(spark, d)).select("id", "category")


@query(over("articles", "SELECT CAST(year(publish_time) AS INTEGER) AS year, count(*) AS n, md5(string_agg(id, ',' ORDER BY publish_time DESC, id)) AS ids_md5 FROM v_articles GROUP BY 1"))
def articles_by_year(spark, d):
    return lists.by_year(W.articles(spark, d)).select("year", "n", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("ids_md5"))


@query(over("articles categories", """, b AS (SELECT id FROM v_articles WHERE status = 1 ORDER BY is_top DESC, view_count DESC, id LIMIT 5), o AS (SELECT *, row_number() OVER () AS k FROM (SELECT id FROM v_articles WHERE status = 1 ORDER BY is_top DESC, view_count DESC, id LIMIT 5))
    SELECT (SELECT string_agg(id, ',' ORDER BY k) FROM o WHERE k <= 3) AS top_articles, (SELECT string_agg(id, ',' ORDER BY k) FROM o) AS latest_and_hot, (SELECT count(*) FROM v_categories WHERE id % 4 <> 0) AS categories, (SELECT count(*) FROM region) AS skills,
    (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1) AS projects, (SELECT count(*) FROM v_articles WHERE status = 1) AS article_count, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1) AS project_count, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS log_count"""))
def home_page(spark, d):
    skills = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(1).alias("status"), F.col("r_regionkey").alias("sort"))
    projects = table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 2).alias("status"), F.col("s_suppkey").alias("sort"))
    h = articles.home(W.articles(spark, d), _categories(spark, d), skills, projects, _logs(spark, d))
    ids, n = (lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)), (lambda c: F.size(c).cast("long").alias(c))
    return h.select(ids("top_articles"), ids("latest_and_hot"), n("categories"), n("skills"), n("projects"), "article_count", "project_count", "log_count")


@query(over("articles categories", "SELECT a.id, contains(c.name, 'NATION_1') AS by_category FROM v_articles a LEFT JOIN v_categories c ON a.category_id = c.id WHERE status = 1 AND (a.id % 9 = 0 OR contains(c.name, 'NATION_1'))"))
def search_published(spark, d):
    c = W.categories(spark, d)
    a = W.articles(spark, d).withColumn("summary", F.when(F.col("id") % 9 == 0, "one of a nation, 1")).withColumn("content", F.lit("stagnation 1"))
    found = articles.search_articles(a, c, "NATION_1")
    return found.join(c.select(F.col("id").alias("category_id"), "name"), "category_id", "left").select("id", F.col("name").contains("NATION_1").alias("by_category"))


@query(over("articles", "SELECT id, status FROM v_articles WHERE contains(title, 'urgent') OR contains(title, 'URGENT')"))
def search_admin(spark, d):
    a = W.articles(spark, d).withColumn("summary", F.lit("")).withColumn("content", F.lit(""))
    return articles.search_articles(a, W.categories(spark, d), "urgent", admin=True).select("id", "status")


@query(over("articles", "SELECT id FROM v_articles WHERE status = 1"))
def search_blank(spark, d):
    a = W.articles(spark, d).withColumn("summary", F.lit("")).withColumn("content", F.lit(""))
    return articles.search_articles(a, W.categories(spark, d), "  ").select("id")


@query("""WITH i AS (SELECT l_orderkey AS s, l_linenumber AS k, 'part ' || l_partkey AS t FROM lineitem), n AS (SELECT s, string_agg(t, ',' ORDER BY k, t) AS titles FROM i GROUP BY 1) SELECT o_orderkey AS id, coalesce(titles, '') AS titles FROM orders LEFT JOIN n ON s = o_orderkey""")
def sections_nested(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("sort_order"), F.concat(F.lit("part "), "l_partkey").alias("title"), F.lit("x").alias("one_liner"), F.lit("u").alias("url"))
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return digest.sections_with_items(s, i).select("id", F.array_join(F.transform("items", lambda x: x["title"]), ",").alias("titles"))


# Strategies

_DIMENSIONS = V.DEPTH_DIMENSIONS + V.BREADTH_DIMENSIONS
_SCORE = dict(zip(_DIMENSIONS, (7, 11, 13, 17, 19, 23), strict=True))  # a dimension's score is (order * this) % 100 / 100
_TRIED_CN, _TRIED_EN = ([w for d in ("depth", "angle", "perspective") for w in words[d]] for words in (V.STRATEGY_SUFFIXES_CN, V.STRATEGY_SUFFIXES_EN))


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _reworded(dimension: str, last: str = "[]") -> str:
    """SQL for the first way to word a keyword anew that wasn't tried."""
    words = f"CASE WHEN cn THEN {_listed(V.STRATEGY_SUFFIXES_CN[dimension])} ELSE {_listed(V.STRATEGY_SUFFIXES_EN[dimension])} END"
    return f"list_filter(list_concat(list_transform({words}, lambda w: keyword || ' ' || w), {last}), lambda x: NOT list_contains(keywords, x))[1]"


_CHOICES = {
    "depth": ("'keyword_refine'", _reworded("depth", f"[keyword || ' 2025 ' || CASE WHEN cn THEN '{V.LATEST_CN}' ELSE '{V.LATEST_EN}' END]"), "engine", "time_range", "NULL"),
    "angle": ("'keyword_refine'", _reworded("angle"), "engine", "time_range", "NULL"),
    "temporal": ("'time_adjust'", "CASE WHEN time_range <> 'all' THEN keyword END", "engine", "MAP {" + ", ".join(f"'{x}': '{y}'" for x, y in V.WIDER_RANGES.items()) + "}[time_range]", "NULL"),
    "diversity": ("CASE WHEN other IS NULL THEN 'site_scope' ELSE 'engine_switch' END", "CASE WHEN other IS NULL THEN keyword || ' ' || place ELSE keyword END", "coalesce(other, engine)", "time_range", "CASE WHEN other IS NULL THEN place END"),
    "perspective": ("'keyword_refine'", _reworded("perspective"), "engine", "time_range", "NULL"),
    "language": ("'cross_language'", "CASE WHEN NOT list_contains(kinds, 'cross_language') THEN keyword END", "engine", "time_range", "NULL"),
}


@query(f"""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS cn, CASE WHEN o_orderkey % 5 = 0 THEN '订单 ' ELSE 'order ' END || o_orderkey AS keyword, {_listed(V.SEARCH_ENGINES)}[1 + o_orderkey % 4] AS engine,
      ['day', 'week', 'month', 'year', 'all'][1 + (o_orderkey // 4) % 5] AS time_range, {_listed(_DIMENSIONS)}[1 + o_orderkey % 6] AS hinted, {", ".join(f"(o_orderkey * {m}) % 100 / 100 AS {d}" for d, m in _SCORE.items())} FROM orders),
    h AS (SELECT l_orderkey AS k, l_linenumber AS r, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
    tried AS (SELECT k, r, {_listed(_DIMENSIONS)}[1 + p % 3] AS dim, keyword || ' ' || CASE WHEN cn THEN {_listed(_TRIED_CN)} ELSE {_listed(_TRIED_EN)} END[1 + s % {len(_TRIED_EN)}] AS keyword, {_listed(V.SEARCH_ENGINES)}[1 + s % 4] AS engine,
      CASE WHEN r % 3 = 0 THEN 'site:' || {_listed(V.STRATEGY_SITES_EN)}[1 + s % 5] END AS site, CASE WHEN p % 4 = 0 THEN 'cross_language' ELSE 'other' END AS kind FROM h JOIN t USING (k)),
    used AS (SELECT k, list(keyword) AS keywords, list(engine) AS engines, list(site) AS sites, list(kind) AS kinds FROM tried GROUP BY k),
    two AS (SELECT k, dim FROM tried QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC) <= 2), tired AS (SELECT k, dim FROM two GROUP BY ALL HAVING count(*) = 2),
    a AS (SELECT t.*, coalesce(keywords, []) AS keywords, coalesce(kinds, []) AS kinds, list_filter({_listed(V.SEARCH_ENGINES)}, lambda x: x <> t.engine AND NOT list_contains(coalesce(engines, []), x))[1] AS other, least({", ".join(_SCORE)}) AS weakest,
      list_filter(list_transform(CASE WHEN cn THEN {_listed(V.STRATEGY_SITES_CN)} ELSE {_listed(V.STRATEGY_SITES_EN)} END, lambda x: 'site:' || x), lambda x: NOT list_contains(coalesce(sites, []), x))[1] AS place FROM t LEFT JOIN used USING (k)),
    c AS ({" UNION ALL ".join(f"SELECT k, {i} AS i, '{d}' AS dimension, {d} AS score, {_CHOICES[d][0]} AS kind, {_CHOICES[d][1]} AS keyword, {_CHOICES[d][2]} AS engine, {_CHOICES[d][3]} AS time_range, {_CHOICES[d][4]} AS site, hinted = '{d}' AND {d} < 0.55 AND {d} - weakest <= 0.15 AS first FROM a WHERE {d} < {V.STRATEGY_THRESHOLDS[d]}" for i, d in enumerate(_DIMENSIONS))})
    SELECT k AS task_id, dimension, score, kind, keyword, engine, time_range, site FROM c WHERE keyword IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tired WHERE tired.k = c.k AND tired.dim = c.dimension)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT first, score, i) = 1""")
def next_strategies(spark, d):
    """What tasks made of orders should search next, after the rounds that their lines are."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").withColumn("_q", F.floor(key / 4)).select(
        key.alias("task_id"), F.concat(F.when(key % 5 == 0, "订单 ").otherwise("order "), key).alias("keyword"), pick("o_orderkey", *V.SEARCH_ENGINES).alias("engine"),
        pick("_q", "day", "week", "month", "year", "all").alias("time_range"), pick("o_orderkey", *_DIMENSIONS).alias("hinted"), *((key * m % 100 / 100).alias(n) for n, m in _SCORE.items()),
    )
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("round_num")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rounds = lines.join(orders.select("task_id", "keyword"), "task_id")
    words = F.when(F.col("task_id") % 5 == 0, pick("s", *_TRIED_CN)).otherwise(pick("s", *_TRIED_EN))
    tried = rounds.select(
        "task_id", "round_num", pick("p", *_DIMENSIONS[:3]).alias("target_dimension"), F.concat_ws(" ", "keyword", words).alias("keyword"), pick("s", *V.SEARCH_ENGINES).alias("engine"),
        F.when(F.col("round_num") % 3 == 0, F.concat(F.lit("site:"), pick("s", *V.STRATEGY_SITES_EN))).alias("site"), F.when(F.col("p") % 4 == 0, "cross_language").otherwise("other").alias("kind"),
    )
    return strategy.next_strategies(orders.select("task_id", "hinted", *_DIMENSIONS), orders.select("task_id", "keyword", "engine", "time_range"), tried, 2025)


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'tech_article' ELSE 'c' || (s_nationkey % 5) || CASE WHEN s_suppkey % 4 = 1 THEN 'k' ELSE '' END END AS name, CASE WHEN s_suppkey % 4 = 1 AND s_nationkey % 5 <> 0 OR s_suppkey % 13 = 0 THEN 'keyword' WHEN s_suppkey % 11 = 0 THEN 'other' WHEN s_suppkey % 3 = 0 THEN 'url' ELSE 'rss' END AS type,
      s_name AS value, CASE WHEN s_nationkey % 6 = 1 THEN 10 ELSE s_nationkey END AS pages, CASE WHEN s_suppkey % 7 = 0 THEN 24 ELSE s_suppkey % 7 * 12 END AS hours, s_suppkey % 9 // 4 AS good, s_suppkey % 4 AS bad, s_nationkey * 4 AS q FROM supplier)
    SELECT name, coalesce(string_agg(value || '|' || CASE WHEN id % 2 = 0 THEN 'deep' ELSE 'single' END || '|1|' || pages || '|' || id || '|' || good || '|' || q, ',' ORDER BY id) FILTER (type = 'url'), '') AS url_sources,
      coalesce(string_agg(value || '|' || hours || '|' || CASE WHEN pages = 0 THEN 10 ELSE pages END || '|' || id || '|' || bad || '|' || id % 3, ',' ORDER BY id) FILTER (type = 'rss'), '') AS rss_sources,
      coalesce(round_even(avg(q) FILTER (type IN ('url', 'rss') AND q > 0), 1), 0) AS avg_quality, coalesce(round_even(sum(good) FILTER (type IN ('url', 'rss')) / nullif(sum(good + bad) FILTER (type IN ('url', 'rss')), 0), 2), 0) AS success_rate,
      CAST(coalesce(sum(good + bad) FILTER (type IN ('url', 'rss')), 0) AS BIGINT) AS total_runs, count(*) FILTER (type IN ('url', 'rss')) = 0 OR sum(good + bad) FILTER (type IN ('url', 'rss')) >= 3 AND sum(good) FILTER (type IN ('url', 'rss')) / sum(good + bad) FILTER (type IN ('url', 'rss')) < 0.2 AS dead
    FROM s WHERE type <> 'other' GROUP BY name""")
def section_sources(spark, d):
    """Sections of suppliers: arrays of what they crawl, shown as text, and how well that did."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    asks = (key % 4 == 1) & (nation % 5 != 0)
    s = table(spark, d, "supplier").select(
        key.alias("id"), F.when(nation % 5 != 0, F.concat(F.lit("c"), nation % 5, F.when(asks, "k").otherwise(""))).alias("category"),
        F.when(key % 26 == 0, None).when(asks | (key % 13 == 0), "keyword").when(key % 11 == 0, "other").when(key % 3 == 0, "url").otherwise("rss").alias("type"), F.col("s_name").alias("value"), F.col("s_name").alias("name"),
        F.when(key % 2 == 0, "deep").alias("crawl_mode"), F.lit(None).cast("int").alias("max_depth"), F.when(nation % 6 != 1, nation).alias("max_pages"), F.when(key % 7 != 0, key % 7 * 12).alias("freshness_hours"),
        F.expr("s_suppkey % 9 div 4").alias("success_count"), F.when(key % 4 != 0, key % 4).alias("fail_count"), (nation * 4).alias("avg_quality_score"), (key % 3).alias("last_result_count"),
    )
    shown = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(x[f] if isinstance(f, str) else x[f[0]][f[1]] for f in fields))), ",").alias(c)
    did = lambda f: ("effectiveness", f)
    return tasks.section_sources(s).select(
        "name", shown("url_sources", "url", "crawl_mode", "max_depth", "max_pages", "source_id", did("success_count"), did("avg_quality_score")),
        shown("rss_sources", "feed_url", "freshness_hours", "max_entries", "source_id", did("fail_count"), did("last_result_count")), "effectiveness.*",
    )


# Functions


@query(r"""SELECT page_id, trim(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp(;|$)', '&', 'g'), '&quot;', '"'), '&#39;', '''')) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language FROM pages""".replace("\\'", "'"))
def page_metadata(spark, d):
    m = readers.page_metadata(table(spark, d, "pages"))
    return m.select("page_id", F.coalesce("title", F.lit("")).alias("title"), "language")


#: What the heads of four kinds of pages tell, by page_id % 4: Open Graph, plain names, JSON-LD with a person, and a graph of JSON-LD.
_HEADS = (
    '<meta property="og:title" content="OG {n}"><meta name="twitter:title" content="TW"><meta property="og:description" content="D &amp; {n}"><meta name="description" content="plain"><meta name="keywords" content="a{n}, b ,, c"><meta name="author" content="A {n}"><meta property="article:published_time" content="2024-01-05T08:00:00Z"><link rel="canonical" href="/c/{n}">',
    '<meta name="description" content="plain {n}"><meta name="twitter:creator" content="@{n}"><meta name="publish_date" content="2024-02-03"><link rel="alternate" href="/rss"><link rel="canonical" href="https://c.org/{n}">',
    '<script type="application/ld+json">{"@type": "BlogPosting", "author": {"name": "P {n}"}, "datePublished": "2024-03-01"}</script>',
    '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "NewsArticle", "author": "Q {n}", "datePublished": "2024-04-01T10:00:00"}]}</script><meta property="article:author" content="">',
)


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'OG ' || page_id END AS og_title, CASE page_id % 4 WHEN 0 THEN 'D & ' || page_id WHEN 1 THEN 'plain ' || page_id END AS description,
    CASE WHEN page_id % 4 = 0 THEN 'a' || page_id || '|b|c' ELSE '' END AS keywords, ['A ', '@', 'P ', 'Q '][1 + page_id % 4] || page_id AS author,
    ['2024-01-05T08:00:00', '2024-02-03T00:00:00', '2024-03-01', '2024-04-01T10:00:00'][1 + page_id % 4] AS published,
    CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/c/' || page_id WHEN 1 THEN 'https://c.org/' || page_id END AS canonical FROM pages
    WHERE NOT regexp_matches(html, '[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}')""")
def metadata_fields(spark, d):
    """All fields of pages whose heads tell them in four ways, and whose own text tells no date."""
    head = F.replace(pick("page_id", *_HEADS), F.lit("{n}"), F.col("page_id").cast("string"))
    p = table(spark, d, "pages").where(~F.col("html").rlike(r"[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"))
    m = readers.page_metadata(p.withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head))))
    og = F.when(F.col("title").rlike("^OG [0-9]+$"), F.col("title"))
    return m.select("page_id", og.alias("og_title"), "description", F.array_join("keywords", "|").alias("keywords"), "author", "published", "canonical")


@query()
def crawl_results(spark, d):
    return readers.crawl_results(table(spark, d, "pages")).select("page_id", "title", "success", "word_count", F.length("raw_markdown").alias("raw_chars"), F.length("markdown").alias("chars"))


_DATES = (("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", ""), ("yyyy-MM-dd'T'HH:mm:ss'+08:00'", "%Y-%m-%dT%H:%M:%S+08:00", "+08:00"), ("yyyy年M月d日", "%Y年%-m月%-d日", ""), ("MMMM d, yyyy", "%B %-d, %Y", ""), ("'on' d", "on %-d", None))


@query("SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+08:00' WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%dT00:00:00') END AS iso FROM events")
def datetime_formats(spark, d):
    written = F.element_at(F.array(*[F.date_format("ts", f) for f, _, _ in _DATES]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), dates.normalize_datetime(written).alias("iso"))


@query("""WITH s AS (SELECT event_id AS id, CAST(floor(epoch(TIMESTAMP '2025-06-01 00:00:00')) - floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN (s // 60) || '分钟前' WHEN s < 86400 THEN (s // 3600) || '小时前' WHEN s < 2592000 THEN (s // 86400) || '天前' WHEN s < 31536000 THEN (s // 2592000) || '个月前' ELSE (s // 31536000) || '年前' END AS ago FROM s""")
def relative_times(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), dates.relative_time(F.col("ts"), F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).alias("ago"))


@query("SELECT event_id AS id, '&gpc=' || to_base64(encode('stf=' || CAST(floor(epoch(ts)) AS BIGINT) || ',' || (CAST(floor(epoch(ts)) AS BIGINT) + 86400) || '|stftype=1')) AS part FROM events")
def search_windows(spark, d):
    start = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), keywords.baidu_window(start, start + F.expr("interval 1 day")).alias("part"))


_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"
_DAYS = "CASE range WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 END"


@query(f"""WITH e AS (SELECT event_id AS id, ts, ['bing', 'baidu', 'sogou', 'google'][1 + event_id % 4] AS engine, ['day', 'week', 'month', 'year', 'all', 'hour'][1 + event_id % 6] AS range FROM events)
    SELECT id, CASE WHEN engine = 'baidu' THEN CASE WHEN {_DAYS} IS NULL THEN '' ELSE '&gpc=' || to_base64(encode('stf=' || ({_EPOCH} - 86400 * {_DAYS}) || ',' || {_EPOCH} || '|stftype=1')) END
      ELSE coalesce(map_extract(MAP {{{", ".join(f"'{e}:{r}': '{v}'" for e, parts in V.SERP_TIMES.items() for r, v in parts.items())}}}, engine || ':' || range)[1], '') END AS part FROM e""")
def search_time_filters(spark, d):
    engine, span = pick("event_id", "bing", "baidu", "sogou", "google"), pick("event_id", "day", "week", "month", "year", "all", "hour")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), keywords.time_filter(engine, span, F.col("ts").cast("timestamp")).alias("part"))


#: An item of each engine's result page, once as its own selector takes it and once as only a fallback does, and what holds the items then.
_ITEMS = {
    "bing": ('<li class="b_algo x"><h2>{a}</h2><div class="b_caption"><p>{s}</p></div></li>', "<li><h2>{a}</h2><p class=b_lineclamp2>{s}</p></li>", "ol id=b_results"),
    "baidu": ('<div class="result c-container"><h3>{a}</h3><div class="c-abstract">{s}</div></div>', '<div class="c-container"><h3>{a}</h3><span class="content-right">{s}</span></div>', "div"),
    "sogou": ('<div class="vrwrap"><div class="vrTitle">{a}</div><p class="star-w">{s}</p></div>', '<div class="rb"><h3>{a}</h3><div class="str-text">{s}</div></div>', 'div class="results"'),
    "google": ('<div class="tF2Cxc"><div class="yuRUbf">{a}</div><div class="VwiC3b">{s}</div></div>', '<div data-sokoban-container="1"><div class="yuRUbf">{a}</div><span class="aCOpRe">{s}</span></div>', "div"),
}


def result_pages(spark, d):
    """Result pages (engine, query, html) that show the stored pages, eight on each. The fourth item has no link; every other four result
    pages hold only what fallback selectors take; two engines wrap addresses."""
    g = F.col("page_id").cast("long") - F.col("page_id") % 8
    engine = pick("_n", *_ITEMS)
    p = table(spark, d, "pages").withColumn("g", g).withColumn("_n", (g / 8).cast("long")).withColumn("engine", engine).withColumn("late", (F.floor(F.col("_n") / 4) % 2 == 1).cast("int"))
    title, snippet = F.regexp_extract("html", "<title>(.*?)</title>", 1), F.regexp_extract("html", "<p>([^<]*)</p>", 1)
    target = F.when(F.col("engine") == "google", F.concat(F.lit("/url?q="), F.url_encode("url"), F.lit("&amp;sa=U")))
    target = F.when(F.col("engine") == "bing", F.concat(F.lit("https://www.bing.com/ck/a?p=1&amp;u=a1"), F.translate(F.base64(F.col("url").cast("binary")), "+/=\r\n", "-_"), F.lit("&amp;ntb=1"))).otherwise(target)
    href = F.coalesce(target, F.replace("url", F.lit("&"), F.lit("&amp;")))
    head = F.when(F.col("engine") == "google", F.concat(F.lit("<h3> "), title, F.lit("</h3>"))).otherwise(title)
    anchor = F.when(F.col("page_id") % 8 == 3, F.concat(F.lit("<b>"), head, F.lit("</b>"))).otherwise(F.concat(F.lit('<a href="'), href, F.lit('">'), head, F.lit("</a>")))
    item = F.lit(None).cast("string")
    for name, forms in _ITEMS.items():
        for late, form in enumerate(forms[:2]):
            before, rest = form.split("{a}")
            middle, after = rest.split("{s}")
            item = F.when((F.col("engine") == name) & (F.col("late") == late), F.concat(F.lit(before), anchor, F.lit(middle), snippet, F.lit(after))).otherwise(item)
    around = F.when(F.col("late") == 0, "div")
    for name, forms in _ITEMS.items():
        around = F.when((F.col("late") == 1) & (F.col("engine") == name), forms[2]).otherwise(around)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x["i"]), "")
    rows = p.groupBy("g", "engine", around.alias("around")).agg(items.alias("items"))
    end = F.concat(F.lit("</"), F.regexp_extract("around", r"^(\w+)", 1), F.lit(">"))
    html = F.concat(F.lit("<!DOCTYPE html><body><ul><li><a href='/images'>Images</a></ul><"), F.col("around"), F.lit(">"), F.col("items"), end, F.lit("<footer><a href='/about'>About</a></footer>"))
    return rows.select("engine", F.col("g").cast("string").alias("query"), html.alias("html"))


_PLAIN = "regexp_replace(replace({}, '&quot;', '\"'), '&amp;?', '&', 'g')"  # a title may be cut within its last reference


@query(f"""WITH p AS (SELECT *, page_id - page_id % 8 AS g FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY page_id) AS rank FROM p)
    SELECT ['bing', 'baidu', 'sogou', 'google'][1 + (g // 8) % 4] AS engine, CAST(g AS VARCHAR) AS query, rank, url, trim({_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
      trim({_PLAIN.format("regexp_extract(html, '<p>([^<]*)</p>', 1)")}) AS snippet FROM r WHERE page_id % 8 <> 3""")
def result_items(spark, d):
    return readers.serp_results(result_pages(spark, d))


@query("""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE len(w) END AS n, md5(CASE WHEN doc_id % 3 = 2 THEN '' ELSE array_to_string(w, '|') END) AS words FROM w""")
def json_lists(spark, d):
    """Whole texts as JSON lists of their words; every third has lost its end."""
    whole = F.to_json(F.split(F.coalesce("text", F.lit("")), " "))
    found = table(spark, d, "documents").select("doc_id", readers.json_list(F.when(F.col("doc_id") % 3 == 2, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)).alias("x"))
    return found.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|").cast("binary")).alias("words"))


@query("""WITH a AS (SELECT doc_id, doc_id % 5 AS k, source || ' ' || doc_id AS t, coalesce(text, '') AS s, coalesce(lang, '') AS l, source FROM documents)
    SELECT doc_id, CASE WHEN k IN (0, 1, 4) THEN t END AS title, CASE WHEN k = 2 THEN 'no_json' WHEN k = 3 THEN 'no_title' WHEN k = 4 OR trim(s) = '' THEN 'no_summary' END AS error,
        CASE WHEN k = 2 THEN '' ELSE concat_ws(',', nullif(l, ''), CASE WHEN source <> l THEN source END) END AS tags, CASE WHEN k IN (0, 1, 3) THEN md5(s) END AS summary FROM a""")
def model_answers(spark, d):
    """Answers about whole documents: fenced, inside prose, prose only, and without title or summary."""
    k, title, summary = F.col("doc_id") % 5, F.concat("source", F.lit(" "), "doc_id"), F.coalesce("text", F.lit(""))
    tags = F.array(F.coalesce("lang", F.lit("")), F.col("source"), F.coalesce("lang", F.lit("")), F.lit(" "))
    body = F.to_json(F.struct(F.when(k != 3, title).alias("title"), F.when(k != 4, summary).alias("summary"), tags.alias("tags")))
    answer = F.when(k == 0, F.concat(F.lit("Here: ```json\n"), body, F.lit("\n```"))).when(k == 2, F.translate(summary, "{}", "()")).otherwise(F.concat(F.lit("so {not this} but "), body, F.lit(" as {asked}")))
    told = table(spark, d, "documents").select("doc_id", digest.parse_answer(answer).alias("a"))
    return told.select("doc_id", "a.title", "a.error", F.array_join("a.tags", ",").alias("tags"), F.md5(F.col("a.summary").cast("binary")).alias("summary"))


@query("""WITH n AS (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n ELSE 0 END AS items, CASE WHEN doc_id % 3 = 1 THEN 'no_json' WHEN doc_id % 3 = 2 OR n = 0 THEN 'no_sections' END AS error FROM n""")
def digest_answers(spark, d):
    """Digests with an item for each line of a document, prose without JSON, and digests without sections."""
    items = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("title"), F.lit("o").alias("one_liner")))
    none = F.filter(items, lambda x: F.lit(False))
    sections = F.array(F.struct(F.col("source").alias("category"), items.alias("items")), F.struct(F.lit("empty").alias("category"), none.alias("items")))
    body = F.to_json(F.struct(F.col("source").alias("highlight"), F.when(F.col("doc_id") % 3 == 0, sections).otherwise(F.filter(sections, lambda x: F.lit(False))).alias("sections")))
    answer = F.when(F.col("doc_id") % 3 == 1, F.translate(F.coalesce("text", F.lit("")), "{}", "()")).otherwise(F.concat(F.lit("Today: "), body))
    return table(spark, d, "documents").select("doc_id", digest.parse_digest(answer).alias("a")).select("doc_id", "a.items", "a.error")


@query("SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'http://www.bing.com/search' ELSE url END AS target FROM pages WHERE NOT regexp_matches(url, '[&#%]')")
def redirects(spark, d):
    p = table(spark, d, "pages").where(~F.col("url").rlike("[&#%]"))
    packed = F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), F.translate(F.base64(F.col("url").cast("binary")), "+/=\r\n", "-_"), F.lit("&ntb=1"))
    u = F.when(F.col("page_id") % 3 == 0, packed).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.google.com/url?sa=t&q="), F.url_encode("url"), F.lit("&ved=1"))).otherwise("http://www.bing.com/search")
    return p.select("page_id", urls.decode_redirect(F.replace(F.replace(u, F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))).alias("target"))


@query("""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2024-02-27 22:31:00', TIMESTAMP '2025-03-05 00:00:00', INTERVAL 1 MINUTE)) AS t),
    f AS (SELECT t, minute(t) AS mi, hour(t) AS h, day(t) AS d, month(t) AS mo, isodow(t) - 1 AS w FROM m),
    s AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k, s_suppkey % 60 AS a, s_suppkey % 24 AS b, s_suppkey % 28 + 1 AS c FROM supplier)
    SELECT id, strftime(min(t), '%Y-%m-%d %H:%M') AS due FROM s LEFT JOIN f ON CASE k WHEN 0 THEN mi = a AND h = b WHEN 1 THEN mi % 7 = 0 AND h BETWEEN 8 AND 18 AND (h - 8) % 2 = 0 AND w <= 4 WHEN 2 THEN mi IN (a, 59) AND d = c AND mo IN (2, 9)
        WHEN 3 THEN mi = 0 AND h = 0 AND d = 29 AND mo = 2 WHEN 4 THEN mi = a AND h = 23 AND d >= c AND w IN (5, 6) END GROUP BY id""")
def schedules(spark, d):
    """When each source is due next."""
    n = lambda k, plus=0: (F.col("s_suppkey") % k + plus).cast("string")
    a, b, c = n(60), n(24), n(28, 1)
    kinds = (F.concat_ws(" ", a, b, F.lit("* * *")), F.lit("*/7 8-18/2 * * 0-4"), F.concat(a, F.lit(",59 * "), c, F.lit(" 2,9 *")), F.lit("0 0 29 2 *"), F.concat(a, F.lit(" 23 "), c, F.lit("-31 * 5,6")), F.lit("@daily"))
    line = F.element_at(F.array(*kinds), (F.col("s_suppkey") % 6 + 1).cast("int"))
    told = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), cron.parsed(line).alias("schedule"))
    due = cron.next_due(F.col("schedule"), F.to_timestamp(F.lit("2024-02-27 22:30:01")))
    return told.select("id", due.alias("due")).select("id", F.date_format("due", "yyyy-MM-dd HH:mm").alias("due"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 150 THEN substr(t, 1, 150) || '...' ELSE t END AS summary FROM t""")
def html_summary(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_summary(F.col("html")).alias("summary"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages".replace("\\", ""))
def html_escaped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html")).cast("binary")).alias("escaped"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT *, length(regexp_extract(h, '(?s)^(.*)\\n\\n', 1)) AS b, length(regexp_extract(h, '(?s)^(.*)\\n', 1)) AS l FROM c)
    SELECT doc_id, CASE WHEN length(text) <= 300 THEN length(text) WHEN b >= 240 THEN b + 14 WHEN l >= 150 THEN l + 14 ELSE 314 END AS chars FROM k""".replace("\\\\", "\\"))
def cut_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(text.cut_at_paragraph(F.col("text"), 300)).cast("long").alias("chars"))


@query("SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 0.0 ELSE round(i / (a + b - i), 6) END AS similarity FROM (SELECT doc_id, len(list_distinct(w)) AS a, 3 AS b, len(list_intersect(list_distinct(w), ['the', 'and', 'of'])) AS i FROM (SELECT doc_id, string_split(substr(text, 1, 200), ' ') AS w FROM documents WHERE text IS NOT NULL))")
def word_overlap(spark, d):
    w = F.array_distinct(F.split(F.substring("text", 1, 200), " "))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(lists.shares_words(w, F.array(*map(F.lit, ("the", "and", "of")))), 6).alias("similarity"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS h FROM pages), s AS (SELECT page_id, string_split(h, '.') AS p FROM h) SELECT page_id, array_to_string(CASE WHEN len(p) >= 3 AND p[len(p) - 1] IN ('co', 'com', 'org', 'net', 'edu', 'gov', 'ac') THEN p[len(p) - 2 :] ELSE p[len(p) - 1 :] END, '.') AS base FROM s""")
def base_domains(spark, d):
    return table(spark, d, "pages").select("page_id", urls.base_domain(F.col("url")).alias("base"))


@query("""WITH n AS (SELECT l_orderkey AS task_id, l_linenumber AS n, l_partkey % 256 AS a, (l_suppkey * 7 + l_orderkey) % 256 AS b FROM lineitem)
    SELECT task_id, n, CASE WHEN n = 1 THEN (task_id % 3 <> 1) ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b BETWEEN 18 AND 19) END AS private FROM n""")
def private_addresses(spark, d):
    """Addresses whose numbers come from order lines; first lines have names."""
    a, b = F.col("l_partkey") % 256, (F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 256
    named = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("http://n"), "l_orderkey", F.lit(".local/"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("http://n"), "l_orderkey", F.lit(".example.org/localhost"))).otherwise(F.lit("https://[fe80::1]/"))
    url = F.when(F.col("l_linenumber") == 1, named).otherwise(F.concat(F.lit("http://"), a.cast("string"), F.lit("."), b.cast("string"), F.lit(".1.2:80/x")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("n"), urls.is_private(url).alias("private"))


def feeds(spark, d) -> DataFrame:
    """A feed for each nation, with an entry for each of its customers: up to four days old or two hours ahead, some undated, untitled, with
    relative addresses or without any."""
    k = F.col("c_custkey")
    at = F.timestamp_seconds(F.lit(1_705_320_000) + 7_200 - (k * 37 % 98) * 3_600 - k % 60)
    date = F.when(k % 7 != 0, F.concat(F.lit("<pubDate>"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"))).otherwise("")
    link = F.when(k % 11 == 0, "").when(k % 3 == 0, F.concat(F.lit("<link>/c/"), k, F.lit("</link>"))).otherwise(F.concat(F.lit("<link>https://x.org/"), k, F.lit("</link>")))
    item = F.concat(F.lit("<item>"), F.when(k % 5 != 0, F.concat(F.lit("<title>"), F.col("c_name"), F.lit("</title>"))).otherwise(""), link, date, F.lit("</item>"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("item")))).alias("items"))
    return rows.select(F.concat(F.lit("https://feeds.org/"), "c_nationkey", F.lit("/rss.xml")).alias("feed_url"), F.concat(F.lit("<rss><channel>"), F.array_join("items.item", ""), F.lit("</channel></rss>")).alias("xml"))


@query("""WITH e AS (SELECT c_nationkey AS f, c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'https://feeds.org/c/' ELSE 'https://x.org/' END || c_custkey AS url,
        CASE WHEN c_custkey % 7 <> 0 THEN 7200 - (c_custkey * 37 % 98) * 3600 - c_custkey % 60 END AS s FROM customer WHERE c_custkey % 11 <> 0),
    good AS (SELECT *, row_number() OVER (PARTITION BY f, s IS NULL ORDER BY k) AS n FROM e WHERE s IS NULL OR s BETWEEN -86400 AND 3600),
    kept AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY coalesce(s, 0) DESC, k) AS m FROM good WHERE s IS NOT NULL OR n <= 2)
    SELECT 'https://feeds.org/' || f || '/rss.xml' AS feed_url, url, title, strftime(TIMESTAMP '2024-01-15 12:00:00' + to_seconds(coalesce(s, 0)), '%Y-%m-%d %H:%M:%S') AS published FROM kept WHERE m <= 10""")
def feed_filter(spark, d):
    e = readers.fresh_entries(readers.read_feeds(feeds(spark, d)), "2024-01-15 12:00:00", 24, 10)
    return e.select("feed_url", "url", "title", F.date_format(F.to_utc_timestamp("published", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("published"))
