"""Small filters, lists and projections over tasks, categories, files, logs, digests and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def categories_page(categories: DataFrame, parent: int | None = None, roots: bool = False, leaf: bool | None = None, status: int | None = None, keyword: str | None = None) -> DataFrame:
    """Conditions that are given; ``roots`` asks for categories without parent; a keyword is looked for in name and slug, taken literally."""
    if roots:
        categories = categories.where(F.col("parent_id").isNull())
    elif parent is not None:
        categories = categories.where(F.col("parent_id") == parent)
    if leaf is not None:
        categories = categories.where(F.col("is_leaf") == leaf)
    if status is not None:
        categories = categories.where(F.col("status") == status)
    if keyword:
        categories = categories.where(F.col("name").contains(keyword) | F.col("slug").contains(keyword))
    return categories


def leaves(categories: DataFrame) -> DataFrame:
    """Active categories that articles may be put into."""
    return categories.where(F.col("is_leaf") & (F.col("status") == 1))


def files_page(files: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Files by part of their name and by kind: image, or document (application or text)."""
    if name:
        files = files.where(F.col("name").contains(name))
    mime = F.col("mime_type")
    if kind == "image":
        files = files.where(mime.startswith("image/"))
    elif kind == "document":
        files = files.where(mime.startswith("application/") | mime.startswith("text/"))
    return files


def seen_lately(pages: DataFrame, hashes: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Hashes (url_hash) that a page of the last ``days`` has."""
    fresh = pages.where(F.col("created_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    return hashes.join(fresh.select("url_hash"), "url_hash", "left_semi")


def usable_results(results: DataFrame, seen: DataFrame, least_chars: int = 0, least_words: int = 0) -> DataFrame:
    """Successful results that are long enough and whose address is new, the first of each address by position."""
    from ..functions.text import count_words
    from .dedup import keep_first

    good = results.where(F.col("success") & (F.length("content") >= least_chars) & (count_words(F.col("content")) >= least_words))
    return keep_first(good.join(seen.select("url"), "url", "left_anti"), F.col("url"), F.col("position"))


def fail_short(results: DataFrame, least_words: int = 50) -> DataFrame:
    """results whose texts have fewer words count as failed, and say so in ``error``."""
    from ..functions.text import count_words

    short = F.col("success") & (count_words(F.coalesce("content", F.lit(""))) < least_words)
    return results.withColumn("error", F.when(short, "too few words")).withColumn("success", F.col("success") & ~short)


def same_content(files: DataFrame, content: str = "content") -> DataFrame:
    """(text_md5, n, first_id) of contents that occur more than once; counted before anything moves, by digests."""
    return files.groupBy(F.md5(F.col(content).cast("binary")).alias("text_md5")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def known_content(new: DataFrame, files: DataFrame) -> DataFrame:
    """(id, known_id): new files (id, md5) that are stored already, and the first such file."""
    return new.join(files.groupBy("md5").agg(F.min("id").alias("known_id")), "md5").select("id", "known_id")


def in_order(rows: DataFrame, group: str, by: str) -> DataFrame:
    """rows with ``place``, 1-based, by ``by`` and id: pages of a task by sort order, rounds by their number."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(by), "id")))


def ranked(results: DataFrame, group: str, *order: Column) -> DataFrame:
    """results with their 1-based rank in each group."""
    return results.withColumn("search_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def visible(df: DataFrame, status: int = 1, order: str = "sort") -> DataFrame:
    """Rows of a status in their order; those without one last."""
    return df.where(F.col("status") == status).orderBy(F.asc_nulls_last(order))


def settings_of(config: DataFrame, group: str | None = None, public: bool = False) -> DataFrame:
    """(key, value) of a group, or of all public settings."""
    rows = config.where(F.col("is_public")) if public else config
    return (rows if group is None else rows.where(F.col("config_group") == group)).select("config_key", "config_value")


def log_stats(logs: DataFrame) -> DataFrame:
    """(logs, words, days, mean_words): the mean is rounded half up."""
    mean = F.floor(F.try_divide(F.sum("word_count"), F.count("*")) + 0.5).cast("long")
    return logs.agg(F.count("*").alias("logs"), F.sum("word_count").cast("long").alias("words"), F.countDistinct("log_date").alias("days"), mean.alias("mean_words"))


def by_month(logs: DataFrame, date: str = "log_date") -> DataFrame:
    """(month, n, last_id): logs of each month, latest first."""
    return logs.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max("id").alias("last_id")).orderBy(F.desc("month"))


def by_year(articles: DataFrame, date: str = "publish_time") -> DataFrame:
    """(year, n, ids): articles of each year, latest year first, latest article first in it; undated ones don't count."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col(date).cast("timestamp"))).alias("t"), "id"))), lambda x: x["id"])
    return articles.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"), ids.alias("ids")).orderBy(F.desc("year"))


def logs_with_category(logs: DataFrame, categories: DataFrame) -> DataFrame:
    """logs with the name of their category, null where there is none."""
    return logs.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")


def representative_keyword(sections: DataFrame) -> DataFrame:
    """(digest_id, keyword) of sections (digest_id, position, name, source_type, keyword): of the first keyword section the shortest of its
    alternatives of 2 to 30 characters (else the shortest), else the first section with a name, else ``technology``."""
    parts = F.filter(F.transform(F.split(F.coalesce("keyword", F.lit("")), " OR "), lambda p: F.trim(p)), lambda p: p != "")
    fit = F.filter(parts, lambda p: F.length(p).between(2, 30))
    shortest = lambda a: F.array_min(F.transform(a, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p"))))["p"]
    word = F.when(F.col("source_type").isin("keyword", "mixed") & (F.size(parts) > 0), F.substring(F.when(F.size(fit) > 0, shortest(fit)).otherwise(shortest(parts)), 1, 100))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("position", c.alias("w"))))["w"]
    named = F.when(F.coalesce("name", F.lit("")) != "", F.col("name"))
    return sections.groupBy("digest_id").agg(F.coalesce(first(word), first(named), F.lit("technology")).alias("keyword"))


def engine_health(searches: DataFrame) -> DataFrame:
    """(engine, attempts, empty, last_results) of (engine, at, results)."""
    return searches.groupBy("engine").agg(F.count("*").alias("attempts"), F.count_if(F.col("results") == 0).alias("empty"), F.max_by("results", F.struct("at", "results")).alias("last_results"))


def latest_digest(tasks: DataFrame, date: str | None = None) -> DataFrame:
    """The newest finished digest with a title, of a day if one is given."""
    rows = tasks.where((F.col("task_type") == "digest") & (F.col("status") == 3) & (F.coalesce("ai_title", F.lit("")) != ""))
    if date is not None:
        rows = rows.where(F.col("digest_date") == date)
    return rows.orderBy(F.desc("digest_date"), F.desc("id")).limit(1)


def highlights(tasks: DataFrame, n: int = 5) -> DataFrame:
    """(digest_date, digest_highlight) of the last ``n`` digests that have one."""
    rows = tasks.where((F.col("task_type") == "digest") & (F.coalesce("digest_highlight", F.lit("")) != ""))
    return rows.orderBy(F.desc("digest_date"), F.desc("id")).limit(n).select("digest_date", "digest_highlight")


def digest_open(tasks: DataFrame, date: str) -> DataFrame:
    """Digests of a day that haven't failed; none means that one may be started."""
    return tasks.where((F.col("task_type") == "digest") & (F.col("digest_date") == date) & (F.col("status") != 4))


def history_pages(tasks: DataFrame, pages: DataFrame, n: int = 3, chars: int = 2000) -> DataFrame:
    """(task_id, url, page_title, head) of the pages of the last ``n`` finished digests; ``n`` rows at most are broadcast."""
    top = tasks.where((F.col("task_type") == "digest") & (F.col("status") == 3)).orderBy(F.desc("id")).limit(n).select(F.col("id").alias("task_id"))
    return pages.join(F.broadcast(top), "task_id").select("task_id", "url", "page_title", F.substring("raw_markdown", 1, chars).alias("head"))


def recent_fingerprints(prints: DataFrame, today: str, days: int = 3) -> DataFrame:
    """Fingerprints of the last ``days``; the filter on the date prunes partitions."""
    return prints.where(F.col("digest_date") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def similar_keyword_rounds(rounds: DataFrame, keyword: str, most: int = 5) -> DataFrame:
    """Rounds with a gain whose keyword holds one of the first five words of this one, best first."""
    words = keyword[:200].split()[:5]
    like = F.lit(False)
    for w in words:
        like = like | F.col("search_keyword").contains(w)
    return rounds.where(like & (F.col("score_delta") > 0)).orderBy(F.desc("score_delta"), "id").limit(most)


def source_scores(runs: DataFrame) -> DataFrame:
    """(source_id, ok, mean_score) of runs (source_id, status, result as JSON with quality_score)."""
    score = F.get_json_object("result", "$.quality_score").try_cast("double")
    return runs.groupBy("source_id").agg(F.count_if(F.col("status") == "success").alias("ok"), F.avg(score).alias("mean_score"))


def task_document(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, document): what a model wrote about a task, or its pages' texts in order, joined by a rule."""
    body = pages.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "raw_markdown"))).alias("s")).select("task_id", F.array_join("s.raw_markdown", "\n\n---\n\n").alias("body"))
    head = F.concat_ws("\n", F.concat(F.lit("> "), F.col("source_url")), F.concat(F.lit("> "), F.array_join("ai_tags", ", ")))
    joined = tasks.join(body, tasks.id == body.task_id, "left")
    return joined.select("id", F.concat_ws("\n\n", F.when(head != "", head), F.coalesce("ai_full_content", "body")).alias("document"))


def aliased(category: Column, aliases: dict[str, str], allowed: tuple[str, ...], other: str = "其他") -> Column:
    """A category's allowed name, by way of its alias, or ``other``."""
    raw = F.coalesce(F.trim(category), F.lit(""))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.lower(raw)), raw) if aliases else raw
    return F.when(named.isin(*allowed), named).otherwise(F.lit(other))


def shares_words(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def needs_other_language(mix: Column) -> Column:
    return mix < 0.5


def cron_fields(line: Column) -> Column:
    """struct of the five fields of a schedule, null if there aren't five."""
    parts = F.split(F.trim(line), r"\s+")
    names = ("minute", "hour", "day", "month", "weekday")
    return F.when(F.size(parts) == 5, F.struct(*[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(names)]))
