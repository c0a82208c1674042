"""DuckDB SQL for every query that SQL can express, written apart from the operators but over the same fixed values."""

from __future__ import annotations

from ..functions import text as T
from ..functions import values as V
from .views import SQL, sql

YEAR, TODAY, NOW = 2025, "2024-01-15", "1998-01-01 00:00:00"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(column: str, words) -> str:
    return f"{column} IN (" + ", ".join(map(lit, words)) + ")"


def any_of(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def count_of(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {lit(pattern)}))"


def normalize(u: str) -> str:
    return f"rtrim(regexp_replace(rtrim(regexp_replace(regexp_replace(lower(trim({u})), '^https?://', ''), '^www\\.', ''), '/'), '[?&](utm_[^&=]*|ref|source)=[^&]*', '', 'g'), '?')"


def netloc(u: str) -> str:
    return f"regexp_extract(lower({u}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"


def domain(u: str) -> str:
    return f"regexp_replace({netloc(u)}, '^www\\.', '')"


def full_path(u: str) -> str:
    p = f"regexp_extract(lower({u}), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    q = f"regexp_extract(lower({u}), '^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*\\?([^#]*)', 1)"
    return f"({p} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def excluded(u: str) -> str:
    n, d, p = netloc(u), domain(u), full_path(u)
    return any_of(
        [among(d, V.EXCLUDED_DOMAINS), *(f"ends_with('.' || {d}, {lit(s)})" for s in V.EXCLUDED_SUFFIXES), *(f"(contains({n}, {lit(a)}) AND contains({p}, {lit(b)}))" for a, b in V.SEARCH_PATHS + V.EXCLUDED_DOMAIN_PATHS),
         f"starts_with({d}, 'amazon.')", f"starts_with({d}, 'ebay.')", f"contains({n}, 'zhihu.com')", among(d, ("v.qq.com", "v.youku.com")), *(f"contains({p}, {lit(x)})" for x in V.EXCLUDED_PATHS), *(f"ends_with({p}, {lit(x)})" for x in V.EXCLUDED_EXTENSIONS)]
    )


def authority(u: str) -> str:
    blogs = any_of(f"ends_with({domain(u)}, {lit(s)})" for s in V.BLOG_SUFFIXES)
    return f"CASE WHEN {among(domain(u), V.OFFICIAL_DOMAINS)} THEN 95 WHEN {among(domain(u), V.COMMUNITY_DOMAINS)} THEN 80 WHEN {excluded(u)} THEN 5 WHEN {blogs} THEN 60 ELSE 50 END"


def words_of(c: str) -> str:
    return f"CAST(floor({count_of(c, '[一-鿿]')} + 1.5 * {count_of(c, '[a-zA-Z]+')}) AS INTEGER)"


def visible(c: str) -> str:
    return f"length(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))"


def plain_text(c: str) -> str:
    for pattern, to in [
        (r"#+\s*", ""), (r"\*\*([^\*]+)\*\*", r"\1"), (r"\*([^\*]+)\*", r"\1"), (r"`([^`]+)`", r"\1"), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"!\[[^\]]*\]\([^\)]+\)", ""),
        (r">\s*", ""), (r"-\s*", ""), (r"\d+\.\s*", ""), (r"\|", " "), (r"-{3,}", ""), (r"\s+", " "),
    ]:
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"
    return f"trim({c})"


def fresh(u: str, c: str) -> str:
    def points(age):
        return f"CASE WHEN {age} <= 1 THEN 5 WHEN {age} <= 2 THEN 2 ELSE 0 END"

    iu = f"TRY_CAST(regexp_extract({u}, '/(20\\d{{2}})/', 1) AS INTEGER)"
    years = [
        f"TRY_CAST(regexp_extract(substr({c}, 1, 3000), {lit(p)}, 1) AS INTEGER)"
        for p in (r"(?i)(?:updated?|published|posted|modified)[\s:]+(\d{4})[-/]\d{1,2}", r"(\d{4})[-/]\d{1,2}[-/]\d{1,2}", r"(\d{4})年\d{1,2}月")
    ]
    dated = "coalesce(" + ", ".join(f"CASE WHEN {y} BETWEEN 2010 AND {YEAR + 1} THEN {y} END" for y in years) + ")"
    return f"CASE WHEN {iu} IS NOT NULL THEN {points(f'({YEAR} - {iu})')} WHEN {dated} IS NOT NULL THEN {points(f'({YEAR} - {dated})')} ELSE 3 END"


def quality(t: str, c: str, u: str, digest: bool = False) -> str:
    n = words_of(c)
    length = f"CASE WHEN {n} >= 2000 THEN 25.0 WHEN {n} >= 1000 THEN 20.0 WHEN {n} >= 500 THEN 15.0 WHEN {n} >= 200 THEN 10.0 ELSE {n} / 20.0 END"
    structure = " + ".join(f"CASE WHEN {matches(c, p)} THEN {k} ELSE 0 END" for p, k in ((r"#{2,4}\s+\S", 8), ("```", 8), (r"(?m)^\s*[-*]\s+\S", 4), (r"(?m)^\s*[-*]\s+.*\n\s{2,}[-*]\s+", 3), (r"\|[\s\-:]+\|", 2)))
    r = f"(CASE WHEN length({c}) > 0 THEN list_sum(list_transform(list_concat(['' ], regexp_extract_all({c}, '(?s)```.*?```')), lambda x: length(x))) / length({c}) ELSE 0 END)"
    code = f"CASE WHEN {r} BETWEEN 0.05 AND 0.5 THEN 25 WHEN {r} > 0.5 THEN greatest(5, CAST(trunc(25 - ({r} - 0.5) * 30) AS INTEGER)) WHEN {r} > 0.01 THEN greatest(5, CAST(trunc({r} / 0.05 * 25) AS INTEGER)) ELSE 5 END"
    code = f"least(25, CAST(floor({authority(u)} / 4) AS INTEGER))" if digest else code
    ads = count_of(c, T.alternation(V.ADS))
    bait = f"least({count_of(f'lower({t})', T.alternation(V.CLICKBAIT))} * 15, 50)"
    return f"greatest(0.0, least(100.0, ({length}) + ({structure}) + ({code}) + 25 * (1 - least({ads} / 5.0, 1.0)) - {bait} - least({ads} * 10, 40) + ({fresh(u, c)})))"


SIGNED = "CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT)"


def prints(text: str, name: str = "prints", rows: str = "documents") -> str:
    return f"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace({text}, '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w FROM {rows}),
    f AS (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN ['en_' || w[1]] ELSE list_transform(range(1, len(w)), lambda i: 'en_' || w[i] || '_' || w[i + 1]) END) AS f FROM w WHERE len(w) > 0),
    h AS (SELECT doc_id, CAST('0x' || substr(md5(f), 1, 16) AS UBIGINT) AS x FROM f),
    b AS (SELECT doc_id, i, count(*) AS n, sum((x >> i) & 1) AS ones FROM h, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS i) GROUP BY ALL),
    s AS (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END) AS h FROM b GROUP BY 1),
    {name} AS (SELECT d.doc_id, coalesce({SIGNED.replace("h ", "s.h ")}, 0) AS h FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id)"""


PREVIEW = "CASE WHEN length(text) > 200 THEN substr(text, 201, 800) ELSE substr(text, 1, 800) END"
U_EXCL = "url || CASE WHEN page_id % 5 = 0 THEN '/login' ELSE '' END"
U_AUTH = "(CASE page_id % 4 WHEN 0 THEN 'https://docs.python.org/' WHEN 1 THEN 'https://me.github.io/' WHEN 2 THEN 'https://www.youtube.com/' ELSE '' END || url)"
U_NAME = "CASE WHEN page_id % 3 = 0 THEN 'https://x.github.com/a' ELSE url END"
BOILER = T.boilerplate_pattern()


def category(u: str, t: str) -> str:
    cases = [f"WHEN {matches(u, p)} THEN {lit(n)}" for p, n in V.CATEGORY_PATHS] + [f"WHEN {among(domain(u), ds)} THEN {lit(n)}" for n, ds in V.CATEGORY_DOMAINS.items()] + [f"WHEN {matches(f'lower({t})', p)} THEN {lit(n)}" for p, n in V.CATEGORY_TITLES]
    return "CASE " + " ".join(cases) + f" ELSE {lit(V.DEFAULT_CATEGORY)} END"


def named(u: str) -> str:
    d = domain(u)
    cases = [f"WHEN {d} = {lit(k)} THEN {lit(v)}" for k, v in V.SOURCE_NAMES.items()] + [f"WHEN ends_with({d}, {lit('.' + k)}) THEN {lit(v)}" for k, v in V.SOURCE_NAMES.items()]
    return "CASE " + " ".join(cases) + f" WHEN {d} <> '' THEN {d} ELSE {lit(V.UNKNOWN_SOURCE)} END"


def points(rules) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in rules)


def page_kind() -> tuple[str, str, str]:
    """Point columns, kind and confidence of pages (u, title, c)."""
    c, u, t = "c", "lower(u)", "lower(title)"
    lines = f"list_filter(string_split({c}, chr(10)), lambda x: trim(x) <> '')"
    path = f"regexp_extract({u}, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({u}, '^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*\\?([^#]*)', 1)"
    res = f"len(list_filter({lines}, lambda x: regexp_matches(x, '\\[([^\\]]+)\\]\\(https?://[^\\)]+\\)') AND length(trim(x)) < 200))"
    link = f"len(list_filter({lines}, lambda x: contains(x, '[') AND contains(x, '](')))"
    of = lambda ws: matches(u, T.alternation(ws))
    err = matches(t, T.alternation(V.ERROR_TITLES))
    short_err = matches(f"lower({c})", T.alternation(V.ERROR_TITLES))
    s = {
        "serp": points([(f"{among(netloc('u'), V.SERP_ROOTS)} AND rtrim({path}, '/') = '' AND {query} = ''", 5), (matches(t, T.alternation(V.SERP_TITLES)), 3), (of(V.SERP_URLS), 3), (matches(c, "|".join(V.SERP_UI)), 2), (f"{res} >= 4 AND {res} / len({lines}) > 0.3", 3), (matches(t, T.alternation(V.SERP_TITLE_WORDS)), 1)]),
        "listing": points([(of(V.LISTING_URLS), 3), (f"{count_of(c, r'\d{4}[-/]\d{2}[-/]\d{2}')} >= 5", 2), (f"{count_of(c, '阅读全文|Read more|继续阅读|查看全文')} >= 3", 2), (f"{count_of(c, r'(?m)^#{1,3}\s')} > 5 AND {count_of(c, '(?m)^[A-Za-z一-鿿].{80,}')} < 2", 2), (matches(c, r"(?i)第\s*\d+\s*页|page\s*\d+\s*of\s*\d+|共\s*\d+\s*页"), 2), (f"{link} / len({lines}) > 0.4 AND {link} >= 5", 2)]),
        "login": points([(f"len(list_intersect(string_split({path}, '/'), [{', '.join(map(lit, V.LOGIN_SEGMENTS))}])) > 0", 3), (matches(c, "(?i)" + T.alternation(V.LOGIN_TEXT)), 2)]),
        "error": points([(err, 3), (f"length(trim({c})) < 500 AND {short_err}", 2)]),
        "paywall": points([(of(V.PAYWALL_URLS), 3), *((matches(c, p), 2) for p in V.PAYWALL_TEXT)]),
        "forum": points([(of(V.FORUM_URLS), 3), (matches(c, "|".join(V.FORUM_UI)), 2)]),
    }
    cols = ", ".join(f"{v} AS {k}" for k, v in s.items())
    kind = "CASE WHEN c = '' THEN 'unknown' " + " ".join(f"WHEN {k} >= 5 THEN '{k}'" for k in s) + " ELSE 'unknown' END"
    conf = "CASE WHEN c = '' THEN 0.0 " + " ".join(f"WHEN {k} >= 5 THEN least({k} / 8, 0.95)" for k in s) + " ELSE 0.0 END"
    return cols, kind, conf


def classify() -> str:
    cols, kind, conf = page_kind()
    return sql("pages", f", p AS (SELECT page_id, title, CASE WHEN page_id % 3 = 0 THEN url || '/forum-1' ELSE url END AS u, content || CASE WHEN page_id % 3 = 0 THEN ' 楼主' ELSE '' END AS c FROM v_pages), s AS (SELECT *, {cols} FROM p) SELECT page_id, {kind} AS page_type, round(CAST({conf} AS DOUBLE), 4) AS confidence FROM s")


SCORED = f", scored AS (SELECT page_id, lang, url, length(content) AS chars, round(CAST({quality('title', 'content', 'url')} AS DOUBLE), 4) AS score, {matches('lower(content)', T.alternation(V.PAYWALL))} AS paywall FROM v_pages) "
EVALUATED = sql("pages", f""", a AS (SELECT page_id, lang, {authority('url')} AS authority, CASE {authority('url')} WHEN 95 THEN 'official' WHEN 80 THEN 'high' WHEN 5 THEN 'spam' ELSE 'medium' END AS level,
    round_even(CAST({quality('title', 'content', 'url')} AS DOUBLE), 1) AS quality FROM v_pages), e AS (SELECT *, round_even(0.4::DOUBLE * authority + 0.6::DOUBLE * quality, 1) AS final_score,
    CASE WHEN level = 'spam' THEN 'reject' WHEN 0.4::DOUBLE * authority + 0.6::DOUBLE * quality >= 65 THEN 'pass' WHEN 0.4::DOUBLE * authority + 0.6::DOUBLE * quality >= 45 THEN 'review' ELSE 'reject' END AS verdict FROM a) """)
CASCADE = sql("pages", f""", p AS (SELECT page_id % 9 AS task_id, page_id AS position, title, page_id % 13 <> 0 AS success, CASE WHEN page_id % 7 = 0 THEN url || '/forum-1' WHEN page_id % 5 = 0 THEN url || '/login' ELSE url END AS u,
    CASE WHEN page_id % 11 = 0 THEN substr(content, 1, 40) WHEN page_id % 7 = 0 THEN content || ' 楼主' ELSE content END AS c FROM v_pages), pts AS (SELECT *, {page_kind()[0]} FROM p), k AS (SELECT *, {page_kind()[1]} AS kind FROM pts),
    q AS (SELECT *, {authority('u')} AS a, CAST({quality('title', 'c', 'u', True)} AS DOUBLE) AS q FROM k), judged AS (SELECT task_id, position, success, CASE WHEN length(c) < 50 THEN 'too_short' WHEN kind <> 'unknown' THEN 'non_article'
    WHEN a = 5 OR (round_even(0.55::DOUBLE * a + 0.45::DOUBLE * q, 1) < 35 AND a <> 95) THEN 'low_quality' END AS reason FROM q) """)
VERDICT = "CASE WHEN score >= 70 AND NOT paywall THEN 'keep' WHEN score >= 50 OR (paywall AND score >= 60) THEN 'review' ELSE 'filter' END"
PAIRS = ", k AS (SELECT h, min(doc_id) AS k FROM prints WHERE h <> 0 GROUP BY 1) SELECT x.k AS a, y.k AS b, CAST(bit_count(xor(x.h, y.h)) AS BIGINT) AS distance FROM k x JOIN k y ON x.k < y.k AND bit_count(xor(x.h, y.h)) <= {t}"
EFFECT = "SELECT {by}, count(*) AS rounds, round(avg(score_delta), 6) AS avg_delta, round(avg(overall_score), 6) AS avg_score, count(*) FILTER (WHERE score_delta > 0) AS improved, round(max(score_delta), 6) AS max_delta FROM v_rounds WHERE round_num > 1 GROUP BY 1"
OK_RUNS = ", runs AS (SELECT visitor_id AS source_id, visit_time, event_id, value AS score, event_type <> 'error' AS ok FROM v_visits) "
def grams(text: str) -> str:
    """Distinct trigrams of padded words."""
    words = f"list_filter(string_split_regex(lower({text}), '[^a-z0-9ß-ÿ一-鿿]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


TEXT_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')"
RESULTS = ", r AS (SELECT page_id % 12 AS g, " + domain("url") + " AS domain, CASE WHEN page_id % 5 = 0 THEN '推荐 best ' || title ELSE title END AS title, content FROM v_pages) "
ITEMS = "WITH i AS (SELECT page_id % 7 AS section, page_id AS position, regexp_replace(url, '/[0-9].*$', '') AS url, substr(html, 100, CAST(page_id % 9 AS INTEGER)) AS one_liner FROM pages) "
LOGS = "WITH r AS (SELECT event_id AS id, event_type AS mood, user_id % 5 AS category_id, CAST(ts AS DATE) AS log_date FROM events ORDER BY log_date DESC, id LIMIT 20) "
TARGET = "[" + ", ".join("1.0" if i % 2 else "-0.5" for i in range(64)) + "]::DOUBLE[]"
LINKS = "l AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 1)"

ORACLE_SQL: dict[str, str] = {
    "url_normalize": f"SELECT page_id, {normalize('url')} AS normalized FROM pages",
    "url_hash": f"SELECT page_id, sha256({normalize('url')}) AS hash FROM pages",
    "url_exclusion": f"SELECT page_id, {netloc('url')} AS host, {excluded(f'({U_EXCL})')} AS excluded FROM pages",
    "url_dedup_first": f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {normalize('url')} ORDER BY page_id) = 1",
    "domain_cap": f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {netloc('url')} ORDER BY page_id) <= 2",
    "source_authority": f"SELECT page_id, {authority(U_AUTH)} AS score, CASE {authority(U_AUTH)} WHEN 95 THEN 'official' WHEN 80 THEN 'high' WHEN 5 THEN 'spam' ELSE 'medium' END AS level FROM pages",
    "infer_category": sql("pages", f"SELECT page_id, {category('url', 'title')} AS category FROM v_pages"),
    "source_name": f"SELECT page_id, {named(f'({U_NAME})')} AS source_name FROM pages",
    "word_count": f"SELECT doc_id, CAST({words_of('text')} AS BIGINT) AS words, {matches('text', '[一-鿿]')} AS cjk FROM documents",
    "reading_time": f"SELECT doc_id, CAST({visible('text')} AS BIGINT) AS chars, CAST(greatest(1, {visible('text')} // 300) AS BIGINT) AS minutes FROM documents",
    "md_to_text_summary": f"WITH t AS (SELECT doc_id, {plain_text('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 200) || '...' END AS summary, md5(t) AS text_md5 FROM t",
    "boilerplate_filter": f"WITH t AS (SELECT doc_id, array_to_string(list_filter(string_split('Subscribe to our newsletter' || chr(10) || text || chr(10) || '版权声明：本文' || chr(10) || 'end', chr(10)), lambda x: NOT {matches('x', BOILER)}), chr(10)) AS k FROM documents) SELECT doc_id, CAST(length(k) AS BIGINT) AS kept_chars, md5(k) AS kept_md5 FROM t",
    "keyword_exclusion": f"SELECT doc_id, {matches('lower(text)', 'the and|von der|que de')} AS excluded FROM documents",
    "page_title_lang": sql("pages", "SELECT page_id, title, lang, CAST(length(content) AS BIGINT) AS content_chars FROM v_pages"),
    "page_link_density": sql("pages", r""", m AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2), lambda x: '[' || x || '](u) '), '') || substr(content, 1, 300) AS md FROM v_pages),
        s AS (SELECT page_id, list_sum(list_concat([0], list_transform(regexp_extract_all(md, '\[([^\]]*)\]\([^)]+\)', 1), lambda x: length(x)))) AS n, length(regexp_replace(regexp_replace(md, '\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '[#*>\-\[\]\(\)!`|~\s]', '', 'g')) AS v FROM m)
        SELECT page_id, round(CASE WHEN v > 0 THEN n / v ELSE 0.0 END, 6) AS ratio FROM s"""),
    "page_classify": classify(),
    "quality_score": sql("pages", SCORED + f"SELECT page_id, score, paywall, {VERDICT} AS recommendation FROM scored"),
    "quality_verdict_by_lang": sql("pages", SCORED + f"SELECT lang, {VERDICT} AS verdict, count(*) AS n, round(avg(score), 4) AS mean_score FROM scored GROUP BY 1, 2"),
    "freshness": sql("pages", ", p AS (SELECT page_id, content, url || CASE page_id % 3 WHEN 0 THEN '/2024/' WHEN 1 THEN '/2019/' ELSE '' END AS u FROM v_pages) " + f"SELECT page_id, CAST({fresh('u', 'content')} AS BIGINT) AS bonus FROM p"),
    "filter_cascade_digest": CASCADE + "SELECT task_id, position, CASE WHEN success THEN reason END AS reason FROM judged",
    "filter_cascade_stats": CASCADE + "SELECT task_id, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS passed, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ("too_short", "non_article", "duplicate", "low_quality")) + " FROM judged WHERE success GROUP BY 1",
    "content_verdict": EVALUATED + "SELECT page_id, authority, level, quality, final_score, verdict FROM e",
    "passing_pages": EVALUATED + "SELECT lang, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict <> 'pass') AS rejected FROM e GROUP BY 1",
    "simhash": f"WITH {prints('text')} SELECT doc_id, h AS simhash FROM prints",
    "simhash_pairs_t3": f"WITH {prints(PREVIEW)}" + PAIRS.format(t=3),
    "simhash_pairs_t5": f"WITH {prints(PREVIEW)}" + PAIRS.format(t=5),
    "simhash_pairs_t12": f"WITH {prints(PREVIEW)}" + PAIRS.format(t=12),
    "greedy_dedup": f"""WITH RECURSIVE {prints(PREVIEW)}, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d.doc_id) AS i, d.doc_id, 'http://' || source || '/' || n_chars AS u, CASE WHEN length({PREVIEW}) >= 100 THEN h END AS h
            FROM documents d JOIN prints p ON p.doc_id = d.doc_id),
        fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS reason, CAST([] AS STRUCT(u VARCHAR, h BIGINT)[]) AS kept
            UNION ALL SELECT i, doc_id, reason, CASE WHEN reason IS NULL THEN list_append(kept, {{'u': u, 'h': h}}) ELSE kept END FROM (SELECT o.i, o.doc_id, o.u, o.h, kept,
                CASE WHEN len(list_filter(kept, lambda k: k.u = o.u)) > 0 THEN 'url' WHEN len(list_filter(kept, lambda k: bit_count(xor(k.h, o.h)) <= 12)) > 0 THEN 'content' END AS reason FROM fold JOIN o ON o.i = fold.i + 1))
        SELECT doc_id, reason FROM fold WHERE i > 0""",
    "simhash_classes": f"WITH {prints(PREVIEW)} SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY h) AS class FROM prints",
    "history_anti": f"WITH {prints(PREVIEW)} SELECT doc_id AS id FROM prints x WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND NOT EXISTS (SELECT 1 FROM prints y WHERE y.doc_id IN (SELECT doc_id FROM labels) AND y.h <> 0 AND x.h <> 0 AND bit_count(xor(x.h, y.h)) <= 12)",
    "history_semi": f"WITH {prints(PREVIEW)} SELECT doc_id AS id FROM prints x WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND EXISTS (SELECT 1 FROM prints y WHERE y.doc_id IN (SELECT doc_id FROM labels) AND y.h <> 0 AND x.h <> 0 AND bit_count(xor(x.h, y.h)) <= 12)",
    "exact_dup_groups": "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "pv_uv_per_article": sql("visits", f"SELECT article_id, count(*) AS pv, count(DISTINCT visitor_id) AS uv, count(*) FILTER (WHERE CAST(visit_time AS DATE) = DATE '{TODAY}') AS pv_today, count(DISTINCT CASE WHEN CAST(visit_time AS DATE) = DATE '{TODAY}' THEN visitor_id END) AS uv_today FROM v_visits GROUP BY 1"),
    "site_uv": "SELECT count(*) AS pv, count(DISTINCT user_id) AS uv FROM events",
    "visitor_state": sql("visits", "SELECT article_id, visitor_id, strftime(min(visit_time), '%Y-%m-%d %H:%M:%S') AS first_view, strftime(max(visit_time), '%Y-%m-%d %H:%M:%S') AS last_view, count(*) AS views FROM v_visits GROUP BY 1, 2"),
    "visits_zero_filled": sql("visits", "SELECT i AS article_id, count(event_id) AS pv FROM range(200) r(i) LEFT JOIN v_visits ON article_id = i GROUP BY 1"),
    "visits_per_minute": "SELECT user_id AS visitor_id, strftime(time_bucket(INTERVAL 60 SECONDS, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "rate_limit_fixed_window": """WITH RECURSIVE e AS (SELECT event_id AS id, user_id % 7 AS ip, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS k FROM events),
        w AS (SELECT id, ip, t, k, t AS start, 1 AS n FROM e WHERE k = 1 UNION ALL
        SELECT e.id, e.ip, e.t, e.k, CASE WHEN e.t - w.start > 3600000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start > 3600000000 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.ip = w.ip AND e.k = w.k + 1)
        SELECT id, ip, n <= 3 AS allowed FROM w""",
    "archive_ym": sql("articles", "SELECT strftime(publish_time, '%Y') AS year, strftime(publish_time, '%m') AS month, count(*) AS n FROM v_articles WHERE status = 1 GROUP BY 1, 2"),
    "top_articles": sql("articles", "SELECT id, view_count, is_top FROM v_articles WHERE status = 1 ORDER BY is_top DESC, view_count DESC, id LIMIT 10"),
    "hot_articles": sql("articles", "SELECT id, view_count FROM v_articles WHERE status = 1 ORDER BY view_count DESC, publish_time DESC, id LIMIT 10"),
    "latest_articles": sql("articles", "SELECT id, strftime(publish_time, '%Y-%m') AS month FROM v_articles WHERE status = 1 ORDER BY publish_time DESC, id LIMIT 10"),
    "article_page": sql("articles", "SELECT id, view_count FROM v_articles WHERE status = 1 ORDER BY is_top DESC, view_count DESC, id LIMIT 20 OFFSET 40"),
    "page_with_total": sql("articles", "SELECT count(*) AS total, (count(*) + 19) // 20 AS pages FROM v_articles WHERE status = 1"),
    "article_enriched": sql("articles categories visits", ", c AS (SELECT article_id, count(*) AS pv, count(DISTINCT visitor_id) AS uv FROM v_visits GROUP BY 1) SELECT a.id, a.title, k.name AS category, p.name AS parent, coalesce(pv, 0) AS pv, coalesce(uv, 0) AS uv FROM v_articles a LEFT JOIN v_categories k ON a.category_id = k.id LEFT JOIN v_categories p ON k.parent_id = p.id LEFT JOIN c ON c.article_id = a.id"),
    "dashboard_totals": "SELECT (SELECT count(*) FROM orders) AS articles, (SELECT count(*) FROM part) AS projects, (SELECT count(*) FROM events) AS pv, (SELECT count(DISTINCT user_id) FROM events) AS uv",
    "status_distribution": sql("articles categories", "SELECT name AS category, CASE status WHEN 1 THEN 'published' WHEN 2 THEN 'draft' ELSE 'recycled' END AS status_name, count(*) AS n FROM v_articles a JOIN v_categories c ON a.category_id = c.id GROUP BY 1, 2"),
    "related_logs": LOGS + ", s AS (SELECT a.id, b.id AS other, CASE WHEN a.mood = b.mood THEN 3 ELSE 0 END + CASE WHEN a.category_id = b.category_id THEN 2 ELSE 0 END + CASE WHEN abs(a.log_date - b.log_date) <= 3 THEN 2 WHEN abs(a.log_date - b.log_date) <= 7 THEN 1 ELSE 0 END AS score FROM r a JOIN r b ON a.id <> b.id) SELECT id, other, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 3",
    "related_articles": sql("articles", """, p AS (SELECT * FROM v_articles WHERE status = 1), same AS (SELECT id, view_count, 0 AS tier FROM p WHERE id <> 3 AND category_id = (SELECT category_id FROM p WHERE id = 3) ORDER BY view_count DESC, id LIMIT 3),
        site AS (SELECT id, view_count FROM p ORDER BY view_count DESC, id LIMIT (SELECT 4 - count(*) FROM same)), fill AS (SELECT id, view_count, 1 AS tier FROM site WHERE id <> 3 AND id NOT IN (SELECT id FROM same) AND (SELECT count(*) FROM same) < 3)
        SELECT id, tier, view_count FROM (SELECT * FROM same UNION ALL SELECT * FROM fill) ORDER BY tier, view_count DESC, id LIMIT 3"""),
    "fts_search": f"SELECT doc_id, round(len(list_filter({TEXT_WORDS}, lambda w: w IN ('the', 'and', 'of'))) / len({TEXT_WORDS}), 6) AS rank FROM documents WHERE list_has_all({TEXT_WORDS}, ['the', 'and', 'of'])",
    "fts_indexed": f"SELECT doc_id, round(len(list_filter({TEXT_WORDS}, lambda w: w IN ('the', 'and', 'of'))) / len({TEXT_WORDS}), 6) AS rank FROM documents WHERE list_has_all({TEXT_WORDS}, ['the', 'and', 'of'])",
    "fuzzy_grams": f"""WITH q AS (SELECT {grams("'thatandzz'")} AS q), g AS (SELECT doc_id, {grams('text')} AS g FROM documents), s AS (SELECT doc_id, len(list_intersect(g, q)) / len(q) AS share FROM g, q)
        SELECT doc_id, round(share, 6) AS share FROM s WHERE share > 0.15""",
    "search_order": sql("categories", f""", a AS (SELECT doc_id AS id, doc_id % 50 = 0 AS is_top, n_chars, doc_id % 25 AS category_id, regexp_extract_all(lower(concat_ws(' ', source, '', text)), '[a-z0-9]+|[一-鿿]') AS w FROM documents),
        r AS (SELECT a.id, is_top, n_chars, len(list_filter(w, lambda x: x IN ('the', 'and'))) / len(w) AS rank FROM a LEFT JOIN v_categories c ON c.id = a.category_id WHERE list_has_all(w, ['the', 'and']) OR contains(c.name, 'the and'))
        SELECT row_number() OVER (ORDER BY is_top DESC, rank DESC, n_chars DESC, id) - 1 AS place, id, round(rank, 6) AS rank FROM r ORDER BY place LIMIT 50"""),
    "vector_lists": f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {TARGET}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {TARGET}) DESC, vec_id LIMIT 10",
    "deep_closure": """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 12 <> 0 THEN p_partkey - 1 END AS parent_id FROM part WHERE p_partkey >= 12),
        up AS (SELECT id AS ancestor, id AS descendant, 0 AS distance FROM n UNION ALL SELECT parent_id, descendant, distance + 1 FROM up JOIN n ON n.id = up.ancestor WHERE parent_id IS NOT NULL)
        SELECT ancestor, descendant, distance, FALSE AS cycle FROM up""",
    "visitors_from_sketches": "SELECT event_type, count(*) AS pv, count(DISTINCT user_id) AS exact, TRUE AS close FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1",
    "vector_topk": f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {TARGET}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {TARGET}) DESC, vec_id LIMIT 10",
    "category_closure": sql("categories closure", "SELECT * FROM v_closure"),
    "category_counts": sql("articles own", "SELECT id, n FROM v_own"),
    "category_rollup_live": sql("articles categories closure own", "SELECT ancestor AS id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM v_closure LEFT JOIN v_own ON descendant = id GROUP BY 1"),
    "category_rollup_leaf": sql("articles categories closure own", "SELECT ancestor AS id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM v_closure LEFT JOIN v_own ON descendant = id WHERE descendant NOT IN (SELECT parent_id FROM v_categories WHERE parent_id IS NOT NULL) GROUP BY 1"),
    "category_path": sql("categories", "SELECT c.id, CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN p.id IS NULL THEN c.name ELSE p.name || ' / ' || c.name END AS path FROM v_categories c LEFT JOIN v_categories p ON c.parent_id = p.id"),
    "category_children": sql("categories", "SELECT c.id, c.name, coalesce(string_agg(k.name, ',' ORDER BY k.id), '') AS children FROM v_categories c LEFT JOIN v_categories k ON k.parent_id = c.id GROUP BY 1, 2"),
    "count_drift": sql("articles categories own", "SELECT c.id, c.id * 10 AS article_count, coalesce(n, 0) AS actual, coalesce(n, 0) - c.id * 10 AS difference FROM v_categories c LEFT JOIN v_own o ON c.id = o.id WHERE parent_id IS NOT NULL AND c.id * 10 <> coalesce(n, 0)"),
    "task_stats": sql("tasks", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 3) AS completed, count(*) FILTER (WHERE status = 4) AS failed, count(*) FILTER (WHERE status IN (0, 1, 2)) AS pending, CAST(coalesce(sum(total_word_count), 0) AS BIGINT) AS words FROM v_tasks"),
    "stale_tasks": sql("tasks", f"SELECT id, status FROM v_tasks WHERE status IN (0, 1, 2) AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTES ORDER BY updated_at, id LIMIT 20"),
    "crawl_summary": "SELECT l_orderkey AS task_id, count(*) FILTER (WHERE l_returnflag = 'N') AS succeeded, CAST(sum(CASE WHEN l_returnflag = 'N' THEN floor(l_extendedprice) ELSE 0 END) AS BIGINT) AS crawl_ms, CAST(sum(l_quantity) AS BIGINT) AS words FROM lineitem GROUP BY 1",
    "engine_effectiveness": sql("rounds", EFFECT.format(by="search_engine")),
    "strategy_effectiveness": sql("rounds", EFFECT.format(by="strategy_type").replace("round_num > 1", "round_num > 1 AND score_delta > 0")),
    "kb_stats": sql("rounds", "SELECT count(DISTINCT task_id) AS tasks, count(*) AS rounds, count(*) FILTER (WHERE round_num > 1 AND score_delta > 0) AS improved, round(avg(CASE WHEN round_num > 1 THEN score_delta END), 6) AS avg_delta, round_even(count(*) FILTER (WHERE round_num > 1 AND score_delta > 0) / count(*) FILTER (WHERE round_num > 1), 2) AS improvement_rate FROM v_rounds"),
    "strategy_hint": sql("rounds", """, b AS (SELECT *, v_rounds.score_delta AS delta FROM v_rounds WHERE score_delta > 0 AND round_num > 1 AND (contains(search_keyword, 'part') OR contains(search_keyword, '1') OR time_range = 'week') ORDER BY score_delta DESC, id LIMIT 50),
        e AS (SELECT search_engine AS k, avg(delta) AS m FROM b GROUP BY 1), t AS (SELECT strategy_type AS k, avg(delta) AS m FROM b GROUP BY 1)
        SELECT (SELECT k FROM e ORDER BY m DESC, k LIMIT 1) AS engine, (SELECT string_agg(k || ':' || printf('%.4f', m), ',' ORDER BY k) FROM e) AS engine_scores, (SELECT k FROM t ORDER BY m DESC, k LIMIT 1) AS strategy_type,
        (SELECT string_agg(k || ':' || printf('%.4f', m), ',' ORDER BY k) FROM t) AS type_scores, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT search_keyword AS k FROM b WHERE search_keyword <> 'part 1' ORDER BY 1 LIMIT 5)) AS related_keywords"""),
    "effective_strategies": sql("rounds", "SELECT id, search_engine, round(score_delta, 6) AS score_delta FROM v_rounds r WHERE r.score_delta > 0.05 AND round_num > 1 ORDER BY r.score_delta DESC, id LIMIT 20"),
    "round_delta": sql("rounds", "SELECT task_id, round_num, round(overall_score - lag(overall_score) OVER (PARTITION BY task_id ORDER BY round_num, overall_score), 4) AS delta FROM v_rounds"),
    "source_ema": sql("visits", OK_RUNS + "SELECT source_id, list_reduce(list(score ORDER BY visit_time, event_id), lambda a, x: CASE WHEN a = 0 THEN floor(x * 100 + 0.5) / 100 ELSE floor((0.7 * a + 0.3 * x) * 100 + 0.5) / 100 END, 0.0::DOUBLE) AS quality, count(*) AS runs FROM runs WHERE ok GROUP BY 1"),
    "source_counters": sql("visits", OK_RUNS + "SELECT source_id, count(*) AS run_count, count(*) FILTER (WHERE ok) AS success_count, count(*) FILTER (WHERE NOT ok) AS fail_count, CASE WHEN last(ok ORDER BY visit_time, event_id) THEN 'success' ELSE 'failed' END AS last_status FROM runs GROUP BY 1"),
    "source_effectiveness": sql("visits", OK_RUNS + ", s AS (SELECT source_id, count(*) AS rc, count(*) FILTER (WHERE ok) AS sc, max(score) AS q FROM runs GROUP BY 1) SELECT source_id % 9 AS section, coalesce(round(avg(CASE WHEN q > 0 THEN q END), 1), 0.0) AS avg_quality, round(sum(sc) / sum(rc), 2) AS success_rate, CAST(sum(rc) AS BIGINT) AS total_runs, sum(rc) >= 3 AND sum(sc) / sum(rc) < 0.2 AS dead FROM s GROUP BY 1"),
    "sections_from_sources": """WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'tech_article' ELSE 'c' || (s_nationkey % 5) END AS name, s_name AS value, s_nationkey AS mp, s_suppkey * 7 AS fh,
        CASE WHEN s_suppkey % 3 = 0 THEN 'url' WHEN s_suppkey % 7 = 0 THEN 'rss' WHEN s_suppkey % 11 = 0 THEN 'other' ELSE 'keyword' END AS kind FROM supplier), g AS (SELECT * FROM s WHERE kind <> 'other')
        SELECT name, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS source_type, max(mp) AS max_items, md5(coalesce(string_agg(CASE WHEN kind = 'keyword' THEN value END, ' OR ' ORDER BY id), '')) AS keyword_md5,
        CASE WHEN min(fh) <= 24 THEN 'day' WHEN min(fh) <= 168 THEN 'week' WHEN min(fh) <= 720 THEN 'month' ELSE 'year' END AS time_range, coalesce(string_agg(CASE WHEN kind = 'url' THEN value END, ',' ORDER BY id), '') AS urls, count(*) FILTER (WHERE kind = 'rss') AS feeds FROM g GROUP BY 1""",
    "crawl_bfs": f"""WITH {LINKS}, d0 AS (SELECT 'p1' AS url, 0 AS depth), d1 AS (SELECT DISTINCT dst AS url, 1 AS depth FROM d0 JOIN l ON url = src), d2 AS (SELECT DISTINCT dst AS url, 2 AS depth FROM d1 JOIN l ON url = src),
        d3 AS (SELECT DISTINCT dst AS url, 3 AS depth FROM d2 JOIN l ON url = src), u AS (SELECT url, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY 1)
        SELECT url, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY depth, url) AS position FROM u ORDER BY depth, url LIMIT 500""",
    "shannon_diversity": "WITH c AS (SELECT doc_id % 7 AS g, source, count(*) AS c FROM documents GROUP BY 1, 2), t AS (SELECT g, sum(c) AS n, count(*) AS k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY 1) SELECT g, round(CASE WHEN n > 1 THEN least(1.0, e / log2(n) * least(1.0, k / 5)) ELSE 0.0 END, 6) AS diversity FROM t",
    "language_mix": sql("pages", RESULTS + ", t AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE regexp_matches(title, '[一-鿿]')) / count(*) AS a, count(*) FILTER (WHERE regexp_matches(title, '[a-zA-Z]{3,}')) / count(*) AS b FROM r GROUP BY 1) SELECT g, round(CASE WHEN a > 0.1 AND b > 0.1 THEN round(least(1.0, 2 * a * b / (a + b) * 1.4), 3) WHEN a > 0.1 OR b > 0.1 THEN round(0.3 + 0.15 * least(1.0, n / 10), 3) ELSE 0.0 END, 2) AS mix FROM t"),
    "coverage_overall": sql("pages", RESULTS + f""", w AS (SELECT *, regexp_extract_all(lower(title), '[一-鿿a-zA-Z]+') AS ws, length(content) AS size FROM r), c AS (SELECT g, domain, count(*) AS c FROM r GROUP BY 1, 2),
        e AS (SELECT g, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY 1),
        b AS (SELECT g, max(len(list_intersect(ws, [{', '.join(map(lit, V.POSITIVE_WORDS))}])) > 0) AS pos, max(len(list_intersect(ws, [{', '.join(map(lit, V.NEGATIVE_WORDS))}])) > 0) AS neg, max(size < 500) AS short, max(size > 3000) AS long, avg(size) AS mean,
            count(*) FILTER (WHERE regexp_matches(title, '[一-鿿]')) / count(*) AS a, count(*) FILTER (WHERE regexp_matches(title, '[a-zA-Z]{{3,}}')) / count(*) AS l FROM w GROUP BY 1),
        s AS (SELECT e.g, n, k AS sources, CASE WHEN n > 1 THEN least(1.0, e / log2(n) * least(1.0, k / 5)) ELSE 0.0 END AS diversity, round_even(CASE WHEN n >= 3 THEN least(1.0, k / 5) ELSE least(1.0, n / 3) END, 3) AS angle,
            round_even(least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN short THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN long THEN 0.4::DOUBLE ELSE 0 END + least(0.15::DOUBLE, mean / 10000)), 3) AS depth,
            round_even(CASE WHEN n >= 2 THEN least(1.0::DOUBLE, n / 6) ELSE 0.2 END * 0.6::DOUBLE + CASE WHEN k >= 2 THEN least(1.0::DOUBLE, k / 4) ELSE 0.3 END * 0.4::DOUBLE, 3) AS temporal,
            round_even(CASE WHEN k >= 2 THEN least(1.0, k / 3) ELSE 0.2 END * 0.5 + CASE WHEN pos AND neg THEN 0.8 WHEN pos OR neg THEN 0.4 ELSE 0.2 END * 0.5, 3) AS perspective,
            CASE WHEN a > 0.1 AND l > 0.1 THEN round_even(least(1.0::DOUBLE, 2 * a * l / (a + l) * 1.4::DOUBLE), 3) WHEN a > 0.1 OR l > 0.1 THEN round_even(0.3::DOUBLE + 0.15::DOUBLE * least(1.0, n / 10), 3) ELSE 0.0 END AS language FROM e JOIN b ON e.g = b.g)
        SELECT g, n, sources, round(angle, 2) AS angle, round(perspective, 2) AS perspective, round(diversity, 4) AS diversity, round(language, 4) AS language, round(depth, 4) AS depth, round(temporal, 4) AS temporal,
            round_even(0.25::DOUBLE * angle + 0.2::DOUBLE * diversity + 0.15::DOUBLE * depth + 0.15::DOUBLE * temporal + 0.15::DOUBLE * perspective + 0.1::DOUBLE * language, 3) AS overall,
            round(0.4::DOUBLE * depth + 0.35::DOUBLE * angle + 0.25::DOUBLE * temporal, 4) AS depth_score, round(0.4::DOUBLE * diversity + 0.35::DOUBLE * perspective + 0.25::DOUBLE * language, 4) AS breadth_score,
            concat_ws(',', CASE WHEN n < 3 THEN 'few results' END, CASE WHEN sources < 3 AND n >= 3 THEN 'few sources' END) AS weaknesses, concat_ws(',', CASE WHEN n < 3 THEN 'other keywords or engine' END, CASE WHEN sources < 3 AND n >= 3 THEN 'other engine' END) AS suggestions FROM s"""),
    "url_window": "SELECT md5(CAST(i AS VARCHAR)) AS url_hash FROM range(120) r(i) WHERE i IN (SELECT user_id % 97 FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAYS)",
    "usable_results": sql("pages", f", r AS (SELECT page_id AS position, regexp_replace(url, '[?#].*$', '') AS u, page_id % 6 <> 0 AS ok, lang, content FROM v_pages) SELECT position, u AS url FROM r WHERE ok AND length(content) >= 300 AND {words_of('content')} >= 50 AND u NOT IN (SELECT u FROM r WHERE lang = 'es') QUALIFY row_number() OVER (PARTITION BY u ORDER BY position) = 1"),
    "log_stats": "SELECT count(*) AS logs, CAST(sum(floor(o_totalprice)) AS BIGINT) AS words, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(floor(sum(floor(o_totalprice)) / count(*) + 0.5) AS BIGINT) AS mean_words FROM orders",
    "logs_by_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, max(o_orderkey) AS last_id FROM orders GROUP BY 1",
    "engine_health": "SELECT event_type AS engine, count(*) AS attempts, count(*) FILTER (WHERE event_id % 4 = 0) AS empty, last(event_id % 4 ORDER BY ts, event_id) AS last_results FROM events GROUP BY 1",
    "similar_keyword_rounds": sql("rounds", "SELECT id, search_keyword, round(score_delta, 6) AS score_delta FROM v_rounds r WHERE (contains(search_keyword, '11') OR contains(search_keyword, '22') OR contains(search_keyword, '33')) AND r.score_delta > 0 ORDER BY r.score_delta DESC, id LIMIT 10"),
    "answer_category": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '后端开发' WHEN 1 THEN 'AI与机器学习' WHEN 2 THEN 'DevOps' WHEN 4 THEN '安全' ELSE '其他' END AS category FROM documents",
    "keyword_relevance": sql("pages", f", p AS (SELECT page_id, lower(title) AS t, lower(title) || ' ' || lower(substr(content, 1, 80)) AS b FROM v_pages) SELECT page_id, trim(t) NOT IN ('', 'no title') AND NOT {matches('b', T.alternation(V.EXCLUDED_KEYWORDS))} AND (regexp_matches(b, '\\bthe and\\b') OR contains(t, 'the') OR contains(t, 'and') OR CAST(contains(b, 'the') AS INTEGER) + CAST(contains(b, 'and') AS INTEGER) >= 2) AS relevant FROM p"),
    "section_overrides": sql("visits", OK_RUNS + ", s AS (SELECT source_id, count(*) AS n, avg(CAST(ok AS INTEGER)) AS r, avg(score) AS q, source_id % 5 = 0 AS dead FROM runs GROUP BY 1) SELECT source_id, CASE WHEN dead OR n < 3 THEN 1.0::DOUBLE WHEN q >= 60 AND r >= 0.6 THEN 2.0::DOUBLE WHEN q >= 40 AND r >= 0.5 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS freshness_multiplier, CASE WHEN NOT dead AND n >= 3 AND q >= 60 AND r >= 0.6 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS items_multiplier FROM s"),
    "stop_rule": sql("rounds", ", r AS (SELECT task_id, round_num, max(overall_score) AS s FROM v_rounds GROUP BY 1, 2), g AS (SELECT *, s - lag(s) OVER (PARTITION BY task_id ORDER BY round_num) AS gain FROM r QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY round_num DESC) = 1) SELECT task_id, s >= 0.9 OR (round_num >= 3 AND coalesce(gain < 0.03, false)) AS stop FROM g"),
    "digest_item_dedup": ITEMS + "SELECT section, position, url FROM i QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(one_liner) DESC, section, position) = 1 OR url = ''",
    "url_repair": """WITH p AS (SELECT page_id % 7 AS task_id, page_id AS position, url FROM pages), i AS (SELECT *, CASE position % 4 WHEN 0 THEN regexp_replace(url, '^https?', 'ftp') WHEN 1 THEN regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') WHEN 2 THEN url || 'zz' ELSE url END AS b FROM p)
        SELECT task_id, position, coalesce((SELECT min(url) FROM p WHERE p.task_id = i.task_id AND p.url = i.b), (SELECT min(url) FROM p WHERE p.task_id = i.task_id AND starts_with(i.b, p.url)), (SELECT min(url) FROM p WHERE p.task_id = i.task_id AND rtrim(regexp_replace(p.url, '^https?://', ''), '/') = rtrim(regexp_replace(i.b, '^https?://', ''), '/')), '') AS fixed FROM i""",
    "digest_pack": """WITH RECURSIVE """ + SQL["pages"] + """, s AS (SELECT page_id // 20 AS task_id, page_id, length(replace(content, ' ', '')) AS n, row_number() OVER (PARTITION BY page_id // 20 ORDER BY length(replace(content, ' ', '')) DESC, page_id) AS k FROM v_pages),
        f AS (SELECT task_id, page_id, k, 20000 AS room, CASE WHEN n <= 4000 THEN n ELSE 4000 + 14 END AS used FROM s WHERE k = 1
        UNION ALL SELECT s.task_id, s.page_id, s.k, f.room - f.used, CASE WHEN f.room - f.used <= 0 THEN 0 WHEN n <= least(4000, f.room - f.used) THEN n ELSE least(4000, f.room - f.used) + 14 END FROM f JOIN s ON f.task_id = s.task_id AND s.k = f.k + 1)
        SELECT task_id, page_id, CAST(used AS BIGINT) AS packed_chars FROM f""",
}
