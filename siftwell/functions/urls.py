"""Column functions over URLs. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normalize_url(url: Column) -> Column:
    """Lower case, without scheme, leading www, trailing slashes and tracking parameters. Null stays null."""
    x = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    x = F.rtrim(F.regexp_replace(x, r"^www\.", ""), F.lit("/"))
    x = F.regexp_replace(x, r"[?&](utm_[^&=]*|ref|source)=[^&]*", "")
    return F.rtrim(x, F.lit("?"))


def url_hash(url: Column) -> Column:
    """SHA-256 of the normalised URL."""
    return F.sha2(normalize_url(url), 256)


def netloc(url: Column) -> Column:
    """Host with port and user part, lower-cased; empty where there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """netloc without a leading www."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)", 1)


def is_excluded(url: Column) -> Column:
    """Advertising, low-value or non-text addresses, by domain first and then by path and extension."""
    full, bare = netloc(url), domain(url)
    where = F.when(query(url) != "", F.concat(path(url), F.lit("?"), query(url))).otherwise(path(url))
    rules = [bare.isin(*V.EXCLUDED_DOMAINS)]
    rules += [F.concat(F.lit("."), bare).endswith(s) for s in V.EXCLUDED_SUFFIXES]
    rules += [full.contains(d) & where.contains(p) for d, p in V.SEARCH_PATHS + V.EXCLUDED_DOMAIN_PATHS]
    rules += [bare.startswith("amazon."), bare.startswith("ebay."), full.contains("zhihu.com"), bare.isin("v.qq.com", "v.youku.com")]
    rules += [where.contains(p) for p in V.EXCLUDED_PATHS]
    rules += [where.endswith(e) for e in V.EXCLUDED_EXTENSIONS]
    return F.coalesce(_any(rules), F.lit(False))


def authority_score(url: Column) -> Column:
    """Trust in a source, 5 to 95."""
    d = domain(url)
    blog = _any(d.endswith(s) for s in V.BLOG_SUFFIXES)
    return F.when(d.isin(*V.OFFICIAL_DOMAINS), 95).when(d.isin(*V.COMMUNITY_DOMAINS), 80).when(is_excluded(url), 5).when(blog, 60).otherwise(50)


def authority_level(url: Column) -> Column:
    return F.when(authority_score(url) == 95, "official").when(authority_score(url) == 80, "high").when(authority_score(url) == 5, "spam").otherwise("medium")


def rated(pages: DataFrame, url: str = "url", known: DataFrame | None = None) -> DataFrame:
    """pages with authority and level. ``known`` (domain, score, level, is_active, is_deleted), a table of at most some thousand sources
    that people keep, goes before the fixed lists; its rows that aren't active don't count."""
    own, told = authority_score(F.col(url)), authority_level(F.col(url))
    if known is None:
        return pages.withColumn("authority", own).withColumn("level", told)
    live = known.where(F.coalesce("is_active", F.lit(True)) & ~F.coalesce("is_deleted", F.lit(False))).groupBy(F.col("domain").alias("_d")).agg(F.max_by(F.struct("score", "level"), "score").alias("_known"))
    joined = pages.withColumn("_d", domain(F.col(url))).join(live, "_d", "left")
    return joined.withColumn("authority", F.coalesce("_known.score", own)).withColumn("level", F.coalesce("_known.level", told)).drop("_d", "_known")


#: Second parts of country domains, as in co.uk (fixed values).
SECOND_LEVEL = ("co", "com", "org", "net", "edu", "gov", "ac")


def base_domain(url: Column) -> Column:
    """The last two labels of the host, three below a country's second level."""
    parts = F.split(netloc(url), r"\.")
    n = F.size(parts)
    deep = (n >= 3) & F.try_element_at(parts, n - 1).isin(*SECOND_LEVEL)
    return F.array_join(F.slice(parts, F.greatest(n - F.when(deep, 2).otherwise(1), F.lit(1)), 3), ".")


def infer_category(url: Column, title: Column) -> Column:
    """By path, then by exact domain, then by title; tech_article otherwise."""
    out = F.lit(None)
    for pattern, name in reversed(V.CATEGORY_TITLES):
        out = F.when(F.lower(title).rlike(pattern), name).otherwise(out)
    for name, domains in reversed(V.CATEGORY_DOMAINS.items()):
        out = F.when(domain(url).isin(*domains), name).otherwise(out)
    for pattern, name in reversed(V.CATEGORY_PATHS):
        out = F.when(url.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit(V.DEFAULT_CATEGORY))


def source_name(url: Column) -> Column:
    """Friendly name by exact domain, by the first suffix that fits, or the domain itself."""
    d = domain(url)
    exact = F.create_map(*[F.lit(x) for kv in V.SOURCE_NAMES.items() for x in kv])
    names = F.array(*[F.struct(F.lit("." + k).alias("k"), F.lit(v).alias("v")) for k, v in V.SOURCE_NAMES.items()])
    suffix = F.try_element_at(F.filter(names, lambda n: F.endswith(d, n["k"])), F.lit(1))["v"]
    return F.coalesce(F.try_element_at(exact, d), suffix, F.when(d != "", d), F.lit(V.UNKNOWN_SOURCE))


def decode_redirect(url: Column) -> Column:
    """The target of a search engine's redirect address: a base64 ``u=a1`` part, or a plain ``q`` or ``url`` part; else the address."""
    packed = F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(packed, "-_", "+/"), (F.ceil(F.length(packed) / 4) * 4).cast("int"), F.lit("="))
    plain = F.regexp_extract(url, r"/url\?(?:[^#]*&)?(?:q|url|u)=(https?[^&#]+)", 1)
    return F.when(url.contains("/ck/a") & (packed != ""), F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")).when(plain != "", F.try_url_decode(plain)).otherwise(url)


def is_private(url: Column) -> Column:
    """Addresses that must never be fetched: local names, private, loopback, link-local and reserved IPv4 and IPv6, and over-long hosts."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    octets = F.transform(F.split(host, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    a, b = F.try_element_at(octets, F.lit(1)), F.try_element_at(octets, F.lit(2))
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inner = a.isin(0, 10, 127) | (a >= 224) | (a == 172) & b.between(16, 31) | (a == 192) & b.isin(168) | (a == 169) & (b == 254) | (a == 100) & b.between(64, 127) | (a == 198) & b.between(18, 19)
    v6 = host.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:(10|127|192\.168|169\.254)\..*)\]$")
    return F.coalesce((host == "") | (F.length(host) > 253) | (host == "localhost") | host.endswith(".localhost") | host.endswith(".local") | v4 & inner | v6, F.lit(True))
