"""The engine's entities over the star-schema test tables: (name -> DataFrame) here, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import table
from ..sources.stored import spread


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, title, lang, content): visible text of stored pages."""
    html = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    return spread(table(spark, d, "pages")).select(
        "page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        T.strip_html(html).alias("content"), "html",
    )


def visits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("article_id"), F.col("user_id").alias("visitor_id"), F.col("ts").alias("visit_time"), "event_type", "value")


def categories(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"), F.col("r_regionkey").alias("sort"))
    leaves = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_nationkey").alias("sort"))
    return roots.union(leaves)


def articles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("category_id"))
    o = table(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("article "), F.col("o_orderpriority")).alias("title"), "category_id",
        F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("status"), F.col("o_orderdate").alias("publish_time"),
        F.floor("o_totalprice").cast("long").alias("view_count"), (F.col("o_orderpriority") == "1-URGENT").alias("is_top"),
    )


def rounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("round_num"), F.col("l_returnflag").alias("search_engine"),
        F.col("l_linestatus").alias("strategy_type"), (F.col("l_discount") - F.col("l_tax")).alias("score_delta"), (F.col("l_quantity") / 50).alias("overall_score"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("search_keyword"), F.when(F.col("l_suppkey") % 3 == 0, "week").otherwise("month").alias("time_range"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "F", 4).otherwise(1).alias("status"), F.col("o_orderpriority").alias("task_type"),
        F.col("o_orderdate").alias("updated_at"), F.floor("o_totalprice").cast("long").alias("total_word_count"),
    )


SQL = {
    "pages": r"""v_pages AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS content, html FROM pages)""",
    "visits": "v_visits AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id, user_id AS visitor_id, ts AS visit_time, event_type, value FROM events)",
    "categories": """v_categories AS (SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey + 1000 AS BIGINT) FROM nation)""",
    "articles": """v_articles AS (SELECT o_orderkey AS id, 'article ' || o_orderpriority AS title, CAST(c_nationkey AS BIGINT) AS category_id,
        CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS status, o_orderdate AS publish_time, CAST(floor(o_totalprice) AS BIGINT) AS view_count,
        o_orderpriority = '1-URGENT' AS is_top FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "rounds": """v_rounds AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS task_id, l_linenumber AS round_num, l_returnflag AS search_engine, l_linestatus AS strategy_type,
        l_discount - l_tax AS score_delta, l_quantity / 50 AS overall_score, 'part ' || l_partkey AS search_keyword,
        CASE WHEN l_suppkey % 3 = 0 THEN 'week' ELSE 'month' END AS time_range FROM lineitem)""",
    "tasks": """v_tasks AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 4 ELSE 1 END AS status, o_orderpriority AS task_type, o_orderdate AS updated_at,
        CAST(floor(o_totalprice) AS BIGINT) AS total_word_count FROM orders)""",
    "closure": """v_closure AS (SELECT id AS ancestor, id AS descendant, 0 AS distance FROM v_categories
        UNION ALL SELECT parent_id, id, 1 FROM v_categories WHERE parent_id IS NOT NULL)""",
    "own": "v_own AS (SELECT category_id AS id, count(*) AS n FROM v_articles WHERE status = 1 GROUP BY 1)",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + body
