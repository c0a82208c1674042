"""Tables, feeds, result pages and HTML metadata as DataFrames."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keywords as keyword_functions
from ..functions import text, urls
from ..functions import values as V
from ..functions.dates import normalize_datetime, utc
from . import selectors


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't softly deleted."""
    return df.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in df.columns else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table without its softly deleted rows; the filter reaches the Parquet scan."""
    return live(spark.read.parquet(f"{folder}/{name}.parquet"))


def lookup(df: DataFrame, **values) -> DataFrame:
    """At most one row with these values."""
    for k, v in values.items():
        df = df.where(F.col(k) == v)
    return df.limit(1)


def existing(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Those of many keys that the table holds: a semi-join instead of one query a key."""
    return keys.join(df.select(key), key, "left_semi")


def json_list(text: Column) -> Column:
    """A JSON list of strings; null, blank and broken ones are empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


# Feeds

FEED = "feed_url string, position int, title string, link string, published string"


def _texts(item: ET.Element) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in item:
        name = x.tag.rpartition("}")[2]
        value = x.get("href") if name == "link" and x.get("href") else (x.text or "").strip()
        if value and (name != "link" or x.get("rel", "alternate") == "alternate"):
            out.setdefault(name, value)
    return out


def feed_items(xml: str | None) -> list[tuple[str | None, str | None, str | None]]:
    """(title, link, published) of an RSS 2.0 or Atom document; none of a broken one."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out = []
    for item in root.iter():
        if item.tag.rpartition("}")[2] in ("item", "entry"):
            t = _texts(item)
            when = t.get("pubDate") or t.get("published") or t.get("updated") or t.get("date")
            if when and not re.match(r"\d{4}-", when):
                try:
                    at = parsedate_to_datetime(when)
                    when = (at.astimezone(UTC) if at.tzinfo else at).strftime("%Y-%m-%dT%H:%M:%S")
                except ValueError:
                    when = None
            out.append((t.get("title"), t.get("link"), when))
    return out


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """(feed_url, entries) of feeds (feed_url, xml): all entries of a document as one list of (position, title, url, published), in order.
    Addresses that are relative belong to the feed's; url is null for entries without a link."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [[(i, t, urljoin(u or "", link) if link else None, at) for i, (t, link, at) in enumerate(feed_items(x))] for u, x in zip(b["feed_url"], b["xml"], strict=True)]
            yield pd.DataFrame({"feed_url": b["feed_url"], "entries": lists})

    return feeds.select("feed_url", "xml").mapInPandas(parse, "feed_url string, entries array<struct<position: int, title: string, url: string, published: string>>")


def fresh_lists(feeds: DataFrame, now: str, hours: int = 24, most: int = 10) -> DataFrame:
    """What fresh_entries tells, for feeds (feed_url, entries) that hold each document's entries as a list, without a shuffle: in batches and
    in streams. Freshness is asked first; then a fifth of ``most`` undated entries (at least one) may stay, and ``most`` in all."""
    ts = F.to_timestamp(F.lit(f"{now}+00:00"), "yyyy-MM-dd HH:mm:ssXXX")
    timed = F.transform("entries", lambda e: F.struct((-F.unix_micros(F.coalesce(utc(e["published"]), ts))).alias("newest"), e["position"].alias("position"), utc(e["published"]).alias("at"), e["url"].alias("url"), F.coalesce(e["title"], F.lit("")).alias("title")))
    good = F.filter("timed", lambda e: F.coalesce(e["url"], F.lit("")).rlike("^https?://"))
    dated = F.filter(good, lambda e: e["at"].isNotNull() & (e["at"] >= ts - F.expr(f"interval {hours} hours")) & (e["at"] <= ts + F.expr("interval 1 hour")))
    undated = F.slice(F.filter(good, lambda e: e["at"].isNull()), 1, max(1, most // 5))
    kept = F.slice(F.array_sort(F.concat(dated, undated)), 1, most)
    rows = feeds.withColumn("timed", timed).select("feed_url", F.explode(kept).alias("e"))
    return rows.select("feed_url", "e.url", "e.title", F.coalesce("e.at", ts).alias("published"))


def read_feeds(feeds: DataFrame) -> DataFrame:
    """One row for each entry of feeds (feed_url, xml)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, i, *e) for u, x in zip(b["feed_url"], b["xml"], strict=True) for i, e in enumerate(feed_items(x))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEED.split(", ")])

    return feeds.select("feed_url", "xml").mapInPandas(parse, FEED)


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """An address as it is meant on a page of another address."""
    return pd.Series([urljoin(b or "", x) for b, x in zip(base, link, strict=True)], dtype=object)


def fresh_entries(entries: DataFrame, now: str, hours: int = 24, most: int = 10) -> DataFrame:
    """Entries with a link to a page (relative ones belong to the feed's address), not older than ``hours`` and not over an hour ahead,
    newest first, ``most`` a feed. Times are UTC, ``now`` too; entries without a title stay, with an empty one.

    Undated entries count as new, but at most a fifth of ``most`` of them (at least one) stay.
    """
    ts = F.to_timestamp(F.lit(f"{now}+00:00"), "yyyy-MM-dd HH:mm:ssXXX")
    dated = entries.withColumn("_t", utc(F.col("published"))).withColumn("title", F.coalesce("title", F.lit("")))
    good = dated.where(F.coalesce("link", F.lit("")) != "").withColumn("url", joined_url(F.col("feed_url"), F.col("link"))).where(F.col("url").rlike("^https?://"))
    good = good.where(F.col("_t").isNull() | (F.col("_t") >= ts - F.expr(f"interval {hours} hours")) & (F.col("_t") <= ts + F.expr("interval 1 hour")))
    n = F.row_number().over(Window.partitionBy("feed_url", F.col("_t").isNull()).orderBy(F.desc("_t"), "position"))
    kept = good.withColumn("_n", n).where(F.col("_t").isNotNull() | (F.col("_n") <= max(1, most // 5)))
    m = F.row_number().over(Window.partitionBy("feed_url").orderBy(F.desc(F.coalesce("_t", ts)), "position"))
    return kept.withColumn("_m", m).where(F.col("_m") <= most).select("feed_url", "url", "title", F.coalesce("_t", ts).alias("published"))


# Metadata of HTML pages

META = ("title", "description", "keywords", "author", "published", "language", "canonical")
PUBLISHED_NAMES = ("article:published_time", "publish_date", "publishedDate", "datePublished", "date", "DC.date.issued", "dc.date")
TEXT_DATES = (r"发表于\s*(\d{4}[年/-]\d{1,2}[月/-]\d{1,2})", r"published\s*on\s*(\w+\s+\d{1,2},?\s+\d{4})", r"(\d{4}[/-]\d{1,2}[/-]\d{1,2})")


class _Head(HTMLParser):
    """Meta tags, title, first time element, JSON-LD blocks and visible text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.properties, self.names, self.title, self.time, self.lang, self.canonical = {}, {}, None, None, None, None
        self.ld, self.text, self.inside = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            if a.get("property"):
                self.properties.setdefault(a["property"], a.get("content"))
            if a.get("name"):
                self.names.setdefault(a["name"], a.get("content"))
        elif tag == "html":
            self.lang = self.lang or a.get("lang")
        elif tag == "link" and "canonical" in (a.get("rel") or "").split():
            self.canonical = self.canonical or a.get("href")
        elif tag == "time":
            self.time = self.time or a.get("datetime")
        elif tag == "title" and self.title is None or tag in ("script", "style"):
            self.inside = "ld" if a.get("type") == "application/ld+json" else tag
            if self.inside == "ld":
                self.ld.append("")

    def handle_endtag(self, tag):
        self.inside = None

    def handle_data(self, data):
        if self.inside == "ld":
            self.ld[-1] += data
        elif self.inside == "title":
            self.title = (self.title or "") + data
        elif self.inside is None:
            self.text.append(data)

    def meta(self, *names):
        """The first of these that a tag tells, property before name."""
        for n in names:
            for found in (self.properties, self.names):
                if n in found:
                    return found[n]
        return None

    def dated(self):
        """A date that the text tells near its beginning."""
        body = "".join(self.text)[:5000]
        return next((m[1] for m in (re.search(x, body, re.I) for x in TEXT_DATES) if m), None)

    def article(self):
        """The first JSON-LD block about an article; none if a block before it is broken."""
        try:
            for x in map(json.loads, self.ld):
                if isinstance(x, dict):
                    if x.get("@type") in ("Article", "NewsArticle", "BlogPosting"):
                        return x
                    for y in x.get("@graph") or []:
                        if isinstance(y, dict) and y.get("@type") in ("Article", "NewsArticle"):
                            return y
        except ValueError:
            pass
        return {}


#: Where each field is looked for, in order: meta tags by name, or what else a page holds.
SOURCES = {
    "title": (("og:title", "twitter:title"), lambda p, ld: (p.title or "").strip()),
    "description": (("og:description", "twitter:description", "description"), None),
    "keywords": (("keywords",), None),
    "author": (("author", "article:author", "twitter:creator"), lambda p, ld: ld.get("author", {}).get("name") if isinstance(ld.get("author"), dict) else ld.get("author") and str(ld["author"])),
    "published": (PUBLISHED_NAMES, lambda p, ld: p.time or p.dated()),
    "language": ((), lambda p, ld: p.lang),
    "canonical": ((), lambda p, ld: p.canonical),
}


def metadata_of(html: str | None, url: str | None = None) -> tuple:
    """The fields of META by SOURCES, and what JSON-LD says of the date, for pages whose own can't be read."""
    page = _Head()
    page.feed(html or "")
    ld = page.article()
    found = {}
    for field, (tags, other) in SOURCES.items():
        value = next((v for v in map(page.meta, tags) if v), None)
        found[field] = value or (other(page, ld) if other else None) or None
    if found["canonical"]:
        found["canonical"] = urljoin(url or "", found["canonical"])
    return (*(found[f] for f in META), ld.get("datePublished"))


_FIELDS = (*META, "ld_published")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in _FIELDS]))
def _metadata(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata_of(h, u) for h, u in zip(html, url, strict=True)], columns=list(_FIELDS), dtype=object)


def page_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with title, description, keywords (array), author, published (ISO or null), language and canonical."""
    out = pages.withColumn("_m", _metadata(F.col(html), F.col(url)))
    keywords = F.filter(F.transform(F.split(F.coalesce("_m.keywords", F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    return out.select(*pages.columns, *(F.col(f"_m.{c}").alias(c) for c in ("title", "description", "author", "language", "canonical")), keywords.alias("keywords"), F.coalesce(normalize_datetime(F.col("_m.published")), F.col("_m.ld_published")).alias("published"))


class _Markdown(HTMLParser):
    """Markdown of a page's body: headings, paragraphs, list items, links, emphasis and code; nothing of scripts, styles and heads."""

    BLOCKS = frozenset("p div section article main header footer nav aside ul ol table tr blockquote figure form".split())
    HIDDEN = frozenset("script style noscript template head svg".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[tuple[int, str]] = []
        self.hidden = self.pre = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append((len(self.out), dict(attrs).get("href") or ""))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            text = "".join(self.out[at:]).strip()
            self.out[at:] = [f"[{text}]({href})" if text and href else text]
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in self.BLOCKS or tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n[ \t]*\n\s*", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip()


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown_of)


def crawl_results(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages as results of a crawl: their metadata, raw_markdown, the cleaned markdown (or the raw one, where cleaning leaves too little),
    word_count, success (there is text) and error."""
    raw = page_metadata(pages, html, url).withColumn("raw_markdown", markdown(F.col(html)))
    out = raw.withColumn("markdown", text.fit_or_raw(text.drop_boilerplate(text.drop_navigation(F.col("raw_markdown"))), F.col("raw_markdown")))
    return out.withColumn("word_count", text.count_words(F.col("markdown"))).withColumn("success", F.length("markdown") > 0).withColumn("error", F.when(F.length("markdown") == 0, "no content"))


def sections_of(config: Column, default: list[tuple[str, str, str]]) -> Column:
    """Sections (name, source_type, keyword) of a stored JSON list; the default ones where it is null, broken or empty."""
    found = F.from_json(config, "array<struct<name:string,source_type:string,keyword:string>>")
    usual = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("source_type"), F.lit(k).alias("keyword")) for n, s, k in default])
    good = F.filter(found, lambda x: x["name"].isNotNull())
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(usual)


# Result pages of search engines

SERP_ROWS = "engine string, query string, rank int, href string, title string, snippet string"


def parsed_results(pages: DataFrame) -> DataFrame:
    """(engine, query, rank, href, title, snippet) of result pages (engine, query, html), by each engine's selectors.

    Items are what the first selector of the engine takes that takes anything: its own, then the fallbacks in order. Ranks count all
    items of a page, items without a link give no row. A page of an unknown engine, or without items, gives none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e, q, *r) for e, q, h in zip(b["engine"], b["query"], b["html"], strict=True) if e in V.SERP_SELECTORS for r in result_items(e, h)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SERP_ROWS.split(", ")])

    return pages.select("engine", "query", "html").mapInPandas(parse, SERP_ROWS)


def result_items(engine: str, html: str | None) -> list[tuple[int, str, str, str]]:
    """(rank, href, title, snippet) of one page."""
    by = V.SERP_SELECTORS[engine]
    root = selectors.tree(html)
    items = next((found for s in (by["item"], *by["fallbacks"]) if (found := selectors.select(root, s))), [])
    out = []
    for rank, item in enumerate(items, 1):
        link = selectors.select_one(item, by["link"])
        if link is not None:
            title, snippet = selectors.select_one(item, by["title"]), selectors.select_one(item, by["snippet"])
            out.append((rank, link.attrs.get("href", ""), (link if title is None else title).text(), snippet.text() if snippet is not None else ""))
    return out


def serp_results(pages: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(engine, query, rank, url, title, snippet) of stored result pages (engine, query, html): targets of redirects that tell them, and only
    addresses of the web.

    Two engines' redirects tell nothing; what a fetcher found behind them comes as ``resolved`` (href, target), and links that it doesn't hold
    give no row. An engine's links to its own pages go too.
    """
    rows = parsed_results(pages)
    engine, href = F.col("engine"), F.col("href")
    mute = (engine == "sogou") & href.startswith("/link?url=") | (engine == "baidu") & href.contains("baidu.com/link?url=")
    if resolved is not None:
        known = resolved.where(F.col("href").isNotNull()).groupBy("href").agg(F.min("target").alias("target"))
        rows = rows.join(known, "href", "left")
    target = F.col("target") if resolved is not None else F.lit(None).cast("string")
    plain = urls.decode_redirect(href)
    told = F.when((engine == "bing") & href.contains("/ck/a") & F.contains(plain, F.lit("bing.com")), href).when(engine.isin("bing", "google"), plain).otherwise(href)
    url = F.when(mute, F.when(~((engine == "sogou") & target.contains("sogou.com")), target)).otherwise(told)
    good = rows.withColumn("url", url).where(F.col("url").rlike("^https?://") & ~((engine == "sogou") & href.contains("weixin.sogou.com")))
    return good.select("engine", "query", "rank", "url", "title", "snippet")


def wanted_results(results: DataFrame, keyword: str, most: int = 10, a_domain: int = 2) -> DataFrame:
    """Results of one keyword that aren't excluded and have to do with it, at most ``a_domain`` a host and ``most`` in all, by engine and rank."""
    order = F.array_position(F.array(*map(F.lit, V.SEARCH_ENGINES)), F.col("engine"))
    about = keyword_functions.is_relevant(keyword, F.col("title"), F.col("snippet"))
    good = results.where((F.col("query") == keyword) & ~urls.is_excluded(F.col("url")) & about).withColumn("_h", urls.netloc(F.col("url")))
    at = F.row_number().over(Window.partitionBy("_h").orderBy(order, "rank", "url"))
    return good.withColumn("_a", at).where(F.col("_a") <= a_domain).orderBy(order, "rank", "url").limit(most).drop("_a", "_h")


def merged_results(results: DataFrame, most: int = 10) -> DataFrame:
    """One row for each address of a query, of the first engine that has it; ``most`` a query, by engine and rank."""
    from ..operators.dedup import keep_first

    order = F.array_position(F.array(*map(F.lit, V.SEARCH_ENGINES)), F.col("engine"))
    once = keep_first(results, F.struct("query", "url"), order, F.col("rank"))
    w = Window.partitionBy("query").orderBy(order, "rank", "url")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
