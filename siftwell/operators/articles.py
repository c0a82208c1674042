"""Lists, rankings, related items and search over articles and daily logs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import live

PUBLISHED = 1


def published(articles: DataFrame) -> DataFrame:
    """Published articles that aren't softly deleted, where the table tells."""
    return live(articles.where(F.col("status") == PUBLISHED))


def sort_order(how: str = "latest") -> list[Column]:
    """Sticky ones first, then by time or popularity; ids settle ties."""
    last = {"oldest": F.asc("publish_time"), "popular": F.desc("view_count"), "latest": F.desc("publish_time")}[how]
    return [F.desc("is_top"), last, F.asc("id")]


def page(df: DataFrame, order: list[Column], current: int = 1, size: int = 10) -> DataFrame:
    """One page, 1-based, of at most 100 rows."""
    size = min(size, 100)
    return df.orderBy(*order).offset((current - 1) * size).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    """(total, pages)."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.when(F.lit(size) == 0, F.lit(0)).otherwise(F.floor((F.col("total") + size - 1) / max(size, 1))).cast("long"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tokens(text: Column) -> Column:
    """Distinct search tokens: lower-cased words of letters and digits, and pairs of neighbouring ideographs (a single one as it is)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(words, pairs))


def query_tokens(keyword: str) -> list[str]:
    """The tokens of a keyword; keywords are short."""
    runs = re.findall("[一-鿿]+", keyword)
    return list(dict.fromkeys([*re.findall("[a-z0-9]+", keyword.lower()), *(r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1)))]))


def search(docs: DataFrame, keyword: str, text: str = "text", extra: Column | None = None) -> DataFrame:
    """Rows that hold every token of the keyword (or that ``extra`` admits), with ``rank``: occurrences of the keyword's tokens for each
    token of the row. An empty keyword admits all rows at rank 0.

    Texts are searched for the tokens before any is split: a token must stand as a whole word, a pair of ideographs anywhere.
    """
    wanted = query_tokens(keyword)
    own = F.lower(F.coalesce(F.col(text), F.lit("")))
    whole = [f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])" if t.isascii() else re.escape(t) for t in wanted]
    hit = reduce(lambda a, b: a & b, [own.contains(t) & own.rlike(p) for t, p in zip(wanted, whole, strict=True)], F.lit(True))
    found = F.regexp_count(own, F.lit("|".join(whole))) if whole else F.lit(0)
    rank = F.coalesce(F.try_divide(found, F.regexp_count(own, F.lit("[a-z0-9]+|[一-鿿]"))), F.lit(0.0))
    return docs.where(hit if extra is None else hit | extra).withColumn("rank", rank)


def search_articles(articles: DataFrame, categories: DataFrame, keyword: str, how: str = "latest", admin: bool = False) -> DataFrame:
    """Articles (title, summary, content) that hold the keyword or whose category's name does: sticky ones first, then by rank, then in
    the order asked for. For the public only published ones; for administrators all, by rank and newest first, without the categories.
    A blank keyword gives the plain list."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("content", F.lit("")))
    rows = (articles if admin else published(articles)).withColumn("_text", text)
    if not keyword.strip():
        return rows.drop("_text").withColumn("rank", F.lit(0.0)).orderBy(*sort_order(how))
    if admin:
        return search(rows, keyword, "_text").drop("_text").orderBy(F.desc("rank"), F.desc("publish_time"), "id")
    named = categories.where(F.col("name").contains(keyword)).select(F.col("id").alias("category_id"), F.lit(True).alias("_named"))
    marked = rows.join(F.broadcast(named), "category_id", "left")  # as many categories as people make
    first, *rest = sort_order(how)
    return search(marked, keyword, "_text", F.coalesce("_named", F.lit(False))).drop("_text", "_named").orderBy(first, F.desc("rank"), *rest)


def trigrams(text: Column) -> Column:
    """Distinct triples of characters of every word, with two blanks before and one after it."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9ß-ÿ一-鿿]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def fuzzy_search(docs: DataFrame, keyword: str, text: str = "text", least: float = 0.15) -> DataFrame:
    """Rows with a stretch of words that is like the keyword by more than ``least``, with that likeness as ``rank``.

    The likeness of a stretch is the share of trigrams that both have among those that either has. Only rows that hold enough of the
    keyword's trigrams at all are looked at word by word.
    """
    wanted = trigrams(F.lit(keyword))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, trigrams(F.col(text)))), F.size(wanted)), F.lit(0.0))
    near = docs.where(share > least)
    return near.withColumn("rank", best_extent(F.col(text), F.lit(keyword))).where(F.col("rank") > least)


def extent_similarity(text: str, keyword: str) -> float:
    """The greatest likeness of the keyword's trigrams and those of a stretch of the text's trigrams, in order."""

    def grams(t: str) -> list[str]:
        return [g for w in re.findall("[a-z0-9ß-ÿ一-鿿]+", t.lower()) for p in [f"  {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]

    wanted, own, best = set(grams(keyword)), grams(text), 0.0
    at = [i for i, g in enumerate(own) if g in wanted]
    for k, i in enumerate(at):
        inside, stretch, last = set(), set(), i
        for j in at[k:]:
            stretch.update(own[last : j + 1])
            inside.add(own[j])
            last = j + 1
            best = max(best, len(inside) / (len(wanted) + len(stretch) - len(inside)))
            if len(stretch) > len(wanted) / max(best, 0.01):
                break  # a longer stretch can't be more alike
    return best


@F.pandas_udf(T.DoubleType())
def best_extent(text: pd.Series, keyword: pd.Series) -> pd.Series:
    return pd.Series([extent_similarity(t or "", k) for t, k in zip(text, keyword, strict=True)], dtype="float64")


def search_with_fallback(docs: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    """Exact search, or the fuzzy one if it finds nothing; which one is told when the query runs, not when it is built."""
    exact = search(docs, keyword, text)
    none = exact.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return exact.unionByName(fuzzy_search(docs, keyword, text).join(F.broadcast(none.withColumn("_k", F.lit(True))), F.col("_k")).drop("_n", "_k"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def nearest_to(vectors: DataFrame, target: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k vectors most like one given vector: a scan and a top-k."""
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in target]))
    return vectors.select(key, score.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def status_distribution(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, status_name, n) of articles whose category exists."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    status = F.when(F.col("status") == PUBLISHED, "published").when(F.col("status") == 2, "draft").otherwise("recycled")
    return articles.join(named, "category_id").groupBy("category", status.alias("status_name")).agg(F.count("*").alias("n"))


def _beside(*totals: DataFrame) -> DataFrame:
    """Single rows side by side."""
    keyed = [t.withColumn("_one", F.lit(1)) for t in totals]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def dashboard(articles: DataFrame, projects: DataFrame, log: DataFrame) -> DataFrame:
    """(articles, projects, pv, uv): articles of any status."""
    return _beside(articles.agg(F.count("*").alias("articles")), projects.agg(F.count("*").alias("projects")), log.agg(F.count("*").alias("pv"), F.countDistinct("visitor_id").alias("uv")))


def home(articles: DataFrame, categories: DataFrame, skills: DataFrame, projects: DataFrame, logs: DataFrame) -> DataFrame:
    """One row for the start page: ids of the top three and of the top five articles (shown as latest and as hottest alike), names of
    active categories, visible skills and projects in their order, and numbers of published articles, visible projects and public logs."""
    best = published(articles).orderBy(F.desc("is_top"), F.desc("view_count"), "id").limit(5).select(F.struct((-F.col("is_top").cast("int")).alias("t"), (-F.col("view_count")).alias("v"), "id").alias("s"))
    ids = F.transform(F.array_sort(F.collect_list("s")), lambda x: x["id"])
    names = lambda df, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("sort").isNull().alias("late"), "sort", "name"))), lambda x: x["name"]).alias(name))
    return _beside(
        best.agg(F.slice(ids, 1, 3).alias("top_articles"), ids.alias("latest_and_hot")), names(categories.where("status = 1"), "categories"), names(skills.where("status = 1"), "skills"),
        names(projects.where("status = 1"), "projects"), published(articles).agg(F.count("*").alias("article_count")), projects.where("status = 1").agg(F.count("*").alias("project_count")),
        logs.where("is_public").agg(F.count("*").alias("log_count")),
    )


def related_logs(logs: DataFrame, newest: int = 20, most: int = 3) -> DataFrame:
    """(id, other, score): for each of the newest logs the most related others among them. Mood counts 3, category 2, closeness in days 2 or 1."""
    recent = logs.orderBy(F.desc("log_date"), "id").limit(newest)
    other = recent.select(*(F.col(c).alias(f"o_{c}") for c in ("id", "mood", "category_id", "log_date")))
    days = F.abs(F.datediff("log_date", "o_log_date"))
    score = F.when(F.col("mood") == F.col("o_mood"), 3).otherwise(0) + F.when(F.col("category_id") == F.col("o_category_id"), 2).otherwise(0) + F.when(days <= 3, 2).when(days <= 7, 1).otherwise(0)
    pairs = recent.join(F.broadcast(other), F.col("id") != F.col("o_id")).select("id", F.col("o_id").alias("other"), score.alias("score"))  # at most newest ** 2 rows
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return pairs.where(F.col("score") > 0).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def related_articles(articles: DataFrame, article, most: int = 3) -> DataFrame:
    """Popular articles of the same category; if there are too few, popular ones of the site fill up. The site's list is cut before the
    article itself and those already chosen are taken out, so fewer than ``most`` may come."""
    own = articles.where(F.col("id") == article).select(F.col("category_id").alias("c"))
    same = articles.join(F.broadcast(own), F.col("category_id") == F.col("c")).where(F.col("id") != article).orderBy(F.desc("view_count"), "id").limit(most).select("id", "view_count", F.lit(0).alias("tier"))
    n = same.agg(F.count("*").alias("_n"))
    top = articles.orderBy(F.desc("view_count"), "id").limit(most + 1).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("view_count"), "id")))  # at most four rows
    site = top.join(F.broadcast(n), (F.col("_n") < most) & (F.col("_r") <= most - F.col("_n") + 1)).where(F.col("id") != article).join(same.select("id"), "id", "left_anti")
    return same.unionByName(site.select("id", "view_count", F.lit(1).alias("tier"))).orderBy("tier", F.desc("view_count"), "id").limit(most).select("id", "tier", "view_count")


def enriched(articles: DataFrame, categories: DataFrame, counts: DataFrame) -> DataFrame:
    """Articles with their category, its parent, page views and visitors; missing counts are 0."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "parent_id")
    parents = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    joined = articles.join(named, "category_id", "left").join(parents, "parent_id", "left").join(counts.withColumnRenamed("article_id", "id"), "id", "left")
    return joined.select("id", "title", "category", "parent", F.coalesce("pv", F.lit(0)).alias("pv"), F.coalesce("uv", F.lit(0)).alias("uv"))
