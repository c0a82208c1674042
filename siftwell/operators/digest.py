"""Digests: items without repeats, repaired links, packing into a budget, export."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CUT_MARK, cut_at_paragraph
from .dedup import keep_first


def distinct_items(items: DataFrame) -> DataFrame:
    """One item (section, position, url, one_liner) for each URL, the longest line, of equals the first; those without URL all stay."""
    blank = F.coalesce(F.trim("url"), F.lit("")) == ""
    kept = keep_first(items.where(~blank), F.col("url"), -F.length(F.coalesce("one_liner", F.lit(""))), F.col("section"), F.col("position"))
    return kept.unionByName(items.where(blank))


def bare(url: Column) -> Column:
    return F.rtrim(F.regexp_replace(url, r"^https?://", ""), F.lit("/"))


def repair_urls(items: DataFrame, pages: DataFrame, group: str = "task_id") -> DataFrame:
    """items with ``fixed``: their URL if a page of the task has it, else the page's that it continues, else the one equal without scheme
    and last slash, else empty. Each step is an equi-join within the task; of several pages the first in order of address counts."""
    base = items.withColumn("_n", F.monotonically_increasing_id())
    exact = pages.select(group, "url").distinct().select(group, F.col("url").alias("e"))
    loose = pages.groupBy(group, bare(F.col("url")).alias("_b")).agg(F.min("url").alias("l"))
    out = base.withColumn("e", F.col("url")).join(exact.withColumn("_hit", F.lit(True)), [group, "e"], "left").withColumn("e", F.when(F.col("_hit"), F.col("e"))).drop("_hit")
    out = out.withColumn("_b", bare(F.col("url"))).join(loose, [group, "_b"], "left").drop("_b")
    # a page that the address continues: candidates are the address cut to lengths that addresses of the task's pages have
    sizes = pages.groupBy(group).agg(F.collect_set(F.length("url")).alias("_sizes"))
    cuts = F.transform(F.filter("_sizes", lambda i: i <= F.length("url")), lambda i: F.substring(F.col("url"), F.lit(1), i))
    heads = base.join(sizes, group).select(group, "_n", F.explode(cuts).alias("p")).join(exact.withColumnRenamed("e", "p"), [group, "p"]).groupBy("_n").agg(F.min("p").alias("h"))
    out = out.join(heads, "_n", "left")
    return out.select(*items.columns, F.coalesce("e", "h", "l", F.lit("")).alias("fixed"))


#: How much of a prompt is kept for instructions, the texts that a category is sent at least, and the category of pages without one.
RESERVED, LEAST_TEXTS, USUAL = 8000, 2, "tech_article"
#: Categories of a digest in their order, and levels of sources (fixed values).
CATEGORY_ORDER = ("hot_trend", "open_source", "tech_article", "dev_tool", "paper", "creative")
LEVEL_ORDER = ("official", "high", "medium", "low", "spam")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _place(value: Column, order: Sequence[str], other: int) -> Column:
    """A value's place in a fixed order, from 0; ``other`` for values that aren't in it."""
    at = F.array_position(F.array(*map(F.lit, order)), F.coalesce(value, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(other)


def pack(pages: DataFrame, budget: int = 150_000, per_page: int = 20_000, group: str = "task_id", content: str = "content", key: str = "page_id") -> DataFrame:
    """pages with ``packed``: longest first, each cut to ``per_page`` and to what is left of its task's budget; null when nothing is left.

    How much a cut takes depends on where the text can be cut, so the room of a page is known only behind the one before it: the pages of
    a task, of which a prompt has few, are folded by one expression that holds their first ``per_page`` characters.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    row = F.struct((-F.length(text)).alias("order"), F.col(key).alias("key"), F.substring(text, 1, per_page + 1).alias("head"))
    listed = pages.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        room = F.least(F.lit(per_page), s["left"])
        packed = F.when(room > 0, cut_at_paragraph(x["head"], room))
        return _bound(packed, lambda p: F.struct((s["left"] - F.coalesce(F.length(p), F.lit(0))).alias("left"), F.array_append(s["out"], F.struct(x["key"].alias("key"), p.alias("packed"))).alias("out")))

    kind = pages.schema[key].dataType.simpleString()
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast(f"array<struct<key: {kind}, packed: string>>").alias("out"))
    done = listed.select(group, F.explode(F.aggregate("rows", zero, step, lambda s: s["out"])).alias("x")).select(F.col(group).alias("_g"), F.col("x.key").alias("_k"), "x.packed")
    return pages.join(done, F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k"))).drop("_g", "_k")


def pack_digest(pages: DataFrame, budget: int = 100_000, per_page: int = 8000, group: str = "task_id") -> DataFrame:
    """(task_id, category, place, page_id, mode, packed): pages of a digest by category, in its order, then by level of source and title.

    Every category has an equal share of the budget, less a reserve. Its better half (LEAST_TEXTS at least) is sent as text, cut to what is
    left of the share and of the whole; of the others the summary goes alone, where there is one. Blank pages are left out. A page for
    which nothing is left is omitted, and behind the page that fills the budget of the last category all are left out.

    Places, shares and who is sent as text come from windows; only the sizes are folded, over the pages of one digest.
    """
    named = pages.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(USUAL)))
    digest_, of_category = Window.partitionBy(group), Window.partitionBy(group, "category")
    level, title = _place(F.col("source_level"), LEVEL_ORDER, 2), F.coalesce("title", F.lit(""))
    total = max(budget - RESERVED, budget // 2)
    ranked = named.select(
        group, "category", "page_id", _place(F.col("category"), CATEGORY_ORDER, 99).alias("rank"), F.coalesce("summary", F.lit("")).alias("summary"), F.substring("content", 1, per_page + 1).alias("head"),
        F.row_number().over(of_category.orderBy(level, title, "page_id")).alias("place"), F.count(F.lit(1)).over(of_category).alias("n"), F.size(F.collect_set("category").over(digest_)).alias("categories"),
    )
    told = ranked.withColumn("brief", (F.col("place") > F.greatest(F.lit(LEAST_TEXTS), F.floor(F.col("n") / 2))) & (F.col("summary") != "")).withColumn("share", F.floor(F.lit(total) / F.col("categories")))
    rows = told.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "category", "place", "page_id", "brief", "share", "categories", "summary", "head"))).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        same = s["category"] == x["category"]
        own = F.when(same, s["own"]).otherwise(0)
        met = s["met"] + F.when(~same & (s["own"] * 2 >= x["share"]) & (s["category"] != ""), 1).otherwise(0)  # categories behind that used half of their share
        filled = (s["used"] >= total) & (met + F.when(own * 2 >= x["share"], 1).otherwise(0) == x["categories"])
        room = F.least(F.lit(per_page), F.lit(total) - s["used"], x["share"] - own).cast("int")
        mode = F.when(filled, "left_out").when(x["brief"], "summary").when(room <= 0, "omitted").otherwise("text")

        def put(m: Column) -> Column:
            packed = F.when(m == "text", cut_at_paragraph(x["head"], room)).when(m == "summary", x["summary"])
            taken = lambda p: F.when(m == "text", F.length(p)).otherwise(0)
            entry = lambda p: F.struct(x["category"].alias("category"), x["place"].alias("place"), x["page_id"].alias("page_id"), m.alias("mode"), p.alias("packed"))
            return _bound(packed, lambda p: F.struct(
                (s["used"] + taken(p)).cast("long").alias("used"), x["category"].alias("category"), (own + taken(p)).cast("long").alias("own"), met.cast("int").alias("met"), F.array_append(s["out"], entry(p)).alias("out")
            ))

        return _bound(mode, put)

    kind = pages.schema["page_id"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<category: string, place: int, page_id: {kind}, mode: string, packed: string>>")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit("").alias("category"), F.lit(0).cast("long").alias("own"), F.lit(0).alias("met"), empty.alias("out"))
    return rows.select(group, F.explode(F.aggregate("rows", zero, step, lambda s: s["out"])).alias("x")).select(group, "x.*")


def sections_with_items(sections: DataFrame, items: DataFrame) -> DataFrame:
    """Sections with their items in order, as an array of structs."""
    nested = items.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "title", "one_liner", "url"))).alias("items"))
    return sections.join(nested, sections.id == nested.section_id, "left").drop("section_id").withColumn("items", F.coalesce("items", F.array()))


def export_markdown(sections: DataFrame) -> DataFrame:
    """(task_id, markdown) of sections with items, in order."""
    item = lambda i: F.concat(F.lit("- ["), F.coalesce(i["title"], F.lit("")), F.lit("]("), F.coalesce(i["url"], F.lit("")), F.lit("): "), F.coalesce(i["one_liner"], F.lit("")))
    text = F.concat_ws("\n", F.concat(F.lit("## "), F.col("category_name")), F.array_join(F.transform("items", item), "\n"))
    rows = sections.select("task_id", "sort_order", "id", text.alias("t"))
    return rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "t"))).alias("s")).select("task_id", F.array_join("s.t", "\n\n").alias("markdown"))


def export_task(tasks: DataFrame, pages: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(id, markdown) of tasks: head lines, what a model wrote, and the texts of pages that succeeded (crawl_status 1), in their order."""
    lines = lambda *c: F.array_compact(F.array(*c))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("task_type")), F.col("task_type"))
    quoted = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"> {name}: "), c.cast("string")))
    body = F.concat(F.lit("## "), F.coalesce(F.when(F.col("page_title") != "", F.col("page_title")), F.col("url")), F.lit("\n> 来源: "), F.col("url"), F.lit("\n\n"), F.coalesce("raw_markdown", F.lit("")), F.lit("\n\n---\n"))
    good = pages.where("crawl_status = 1").groupBy("task_id").agg(F.count("*").alias("_good"), F.array_sort(F.collect_list(F.struct("sort_order", "url", body.alias("b")))).alias("_p"))
    joined = tasks.join(good, tasks.id == good.task_id, "left")
    count = F.concat(F.coalesce("_good", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("total_pages", F.lit(0)).cast("string"))
    head = lines(
        F.concat(F.lit("# 爬取任务 #"), F.col("id").cast("string"), F.lit(" - "), named, F.lit("\n")), quoted("URL", F.col("source_url")), quoted("关键词", F.col("keyword")),
        F.concat(F.lit("> 完成时间: "), F.coalesce(F.col("updated_at").cast("string"), F.lit("N/A"))), F.concat(F.lit("> 成功页面: "), count),
        F.concat(F.lit("> 总字数: "), F.coalesce("total_word_count", F.lit(0)).cast("string")), F.lit("\n---\n"),
    )
    wrote = F.coalesce("ai_full_content", F.lit("")) != ""
    title = F.when(F.coalesce("ai_title", F.lit("")) != "", F.concat(F.lit("## AI 整理: "), F.col("ai_title"))).otherwise("## AI 整理结果")
    tags = F.when(F.size(F.coalesce("ai_tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit("> 标签: "), F.array_join("ai_tags", ", ")))
    model = F.when(wrote, F.array_join(lines(F.concat(title, F.lit("\n")), quoted("摘要", F.col("ai_summary")), tags, F.concat(F.lit("\n"), F.col("ai_full_content")), F.lit("\n---\n")), "\n"))
    return joined.select("id", F.concat_ws("\n", head, model, F.coalesce(F.transform("_p", lambda x: x["b"]), F.array().cast("array<string>"))).alias("markdown"))


def context_lines(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, context): what a model is told about a task's aim. Search words where they are known, else the source's address, else up to
    five page titles; null without any."""
    meta = F.from_json("ai_search_metadata", "originalKeyword string, optimizedKeyword string, searchVariants array<string>")
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    words = F.array_compact(F.array(
        F.when(full(meta["originalKeyword"]), F.concat(F.lit("原始关键词："), meta["originalKeyword"])),
        F.when(full(meta["optimizedKeyword"]) & ~meta["optimizedKeyword"].eqNullSafe(meta["originalKeyword"]), F.concat(F.lit("优化关键词："), meta["optimizedKeyword"])),
        F.when(F.size(F.coalesce(meta["searchVariants"], F.array().cast("array<string>"))) > 0, F.concat(F.lit("实际搜索词变体："), F.array_join(meta["searchVariants"], " | "))),
    ))
    url = F.col("source_url")
    domain = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    deep = F.col("task_type") == "deep"
    place = F.array_compact(F.array(
        F.concat(F.when(deep, "深度爬取目标站点：").otherwise("爬取来源："), domain), F.when(path != "", F.concat(F.when(deep, "起始路径：/").otherwise("页面路径：/"), path)),
        F.when(deep, "以上内容来自同一站点的多个页面，请综合分析并围绕站点主题组织内容。").otherwise("请围绕以上来源页面的实际主题组织内容，避免被页面中无关的导航、广告等噪音带偏。"),
    ))
    titled = pages.where(F.coalesce("page_title", F.lit("")) != "").groupBy("task_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "page_title"))), lambda x: x["page_title"]), 1, 5).alias("_t"))
    joined = tasks.join(titled, tasks.id == titled.task_id, "left")
    said = F.when(F.size(F.coalesce(words, F.array().cast("array<string>"))) > 0, F.array_join(words, "\n")).when(full(url), F.array_join(place, "\n")).when(F.col("_t").isNotNull(), F.concat(F.lit("页面标题："), F.array_join("_t", " | ")))
    return joined.select("id", said.alias("context"))


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def json_in(text: str | None) -> str | None:
    """The first JSON object in a model's answer: fenced, or from a brace on that a parser can read to its end. Null if there is none."""
    for part in [*_FENCE.findall(text or ""), text or ""]:
        at = part.find("{")
        while at >= 0:
            try:
                found, _ = json.JSONDecoder().raw_decode(part[at:])
                return json.dumps(found, ensure_ascii=False)
            except ValueError:
                at = part.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(json_in)


ORGANISED = "title string, summary string, key_points array<string>, tags array<string>, category string, full_content string"


def parse_answer(text: Column) -> Column:
    """struct of an answer's fields, and ``error``: no_json, no_title, no_summary, or null."""
    raw = extract_json(text)
    x = F.from_json(raw, ORGANISED)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = F.when(raw.isNull(), "no_json").when(blank(x["title"]), "no_title").when(blank(x["summary"]), "no_summary")
    return F.struct(x["title"].alias("title"), x["summary"].alias("summary"), capped(x["key_points"], 10).alias("key_points"), capped(x["tags"], 8).alias("tags"), x["category"].alias("category"), error.alias("error"))


DIGEST = "highlight string, sections array<struct<category:string,items:array<struct<title:string,one_liner:string,source_url:string>>>>"


def parse_digest(text: Column) -> Column:
    """struct(highlight, sections, items, error) of a digest's answer: items without a title go, sections without items too; the error is
    no_json, no_sections, or null."""
    raw = extract_json(text)
    x = F.from_json(raw, DIGEST)
    titled = lambda s: F.filter(F.coalesce(s["items"], F.array()), lambda i: F.coalesce(F.trim(i["title"]), F.lit("")) != "")
    sections = F.filter(F.transform(x["sections"], lambda s: F.struct(s["category"].alias("category"), titled(s).alias("items"))), lambda s: F.size(s["items"]) > 0)
    n = F.coalesce(F.aggregate(sections, F.lit(0), lambda a, s: a + F.size(s["items"])), F.lit(0))
    return F.struct(x["highlight"].alias("highlight"), sections.alias("sections"), n.alias("items"), F.when(raw.isNull(), "no_json").when(n == 0, "no_sections").alias("error"))


def capped(list_: Column, most: int) -> Column:
    """Distinct non-blank entries in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.coalesce(list_, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), 1, most)
