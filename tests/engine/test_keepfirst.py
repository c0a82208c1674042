"""Keep-first by rounds against the plain fold it stands for."""

import random

from pyspark.sql import functions as F

from siftwell.functions import similarity as S
from siftwell.operators import dedup, keepfirst
from siftwell.plans import catalogue


def fold(rows, most):
    """Reasons of rows (key, group, url, print, title, own) in order, each compared with all that stayed before it in its group."""
    kept, out = {}, {}
    for key, g, u, h, t, own in rows:
        seen = kept.setdefault(g, [])
        if any(u == x for x, _, _ in seen):
            reason = "url"
        elif h is not None and any(x is not None and ((h ^ x) & (2**64 - 1)).bit_count() <= most for _, x, _ in seen):
            reason = "content"
        elif t and any(S.title_similarity_of(t, x) >= dedup.SIMILAR_TITLE for _, _, x in seen if x):
            reason = "title"
        else:
            reason = own
        if reason is None:
            seen.append((u, h, t))
        out[key] = reason
    return out


def test_random_chains_of_conflicts_equal_the_fold(spark):
    rng = random.Random(8)
    titles = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 3)) for _ in range(8)) for _ in range(12)]
    rows, h = [], rng.getrandbits(64)
    for i in range(300):
        h = h ^ sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 20]))) if rng.random() < 0.8 else rng.getrandbits(64)  # long chains of near prints
        t = rng.choice(titles)
        t = rng.choice([t, t + " x", t.replace("alpha1", "alpha2"), "", f"{rng.random()}"])
        rows.append((i, i % 2 if i % 3 else 0, f"u{rng.randint(0, 250)}", None if rng.random() < 0.2 else h - 2**64 if h >= 2**63 else h, t, "low_quality" if rng.random() < 0.15 else None))
    df = spark.createDataFrame(rows, "pos long, grp long, _u string, _h long, _t string, low string")
    for most in (3, 5):
        got = {r.pos: r.reason for r in dedup._folded(df, ["grp"], ["pos"], most, F.col("low")).collect()}
        assert got == fold(rows, most)


def test_all_pages_as_one_group_equal_the_fold(spark):
    folder = "/root/testdata/sf0.001"
    told = dedup._told(catalogue.W.pages(spark, folder), "url", "title", "content").orderBy("page_id").collect()
    want = fold([(r.page_id, 0, r["_u"], r["_h"], r["_t"], None) for r in told], dedup.WITHIN)
    assert {r.page_id: r.reason for r in catalogue.QUERIES["greedy_pages"](spark, folder).collect()} == want


def test_a_hot_class_is_represented_by_its_least_row(spark):
    """A third of all rows share one address: members of a class are never paired with each other."""
    df = spark.range(30000).selectExpr("id AS pos", "IF(id % 3 = 0, 'hot', CAST(id AS string)) AS _u", "CAST(NULL AS bigint) AS _h", "'' AS _t")
    got = dedup._folded(df, [], ["pos"], 3, F.lit(None).cast("string")).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {None: 20001, "url": 9999}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "pos long, _u string, _h long, _t string")
    assert dedup._folded(df, [], ["pos"], 3, F.lit(None).cast("string")).count() == 0
    assert keepfirst.reached(spark.createDataFrame([], "g int, c string, r long"), spark.createDataFrame([], "g int, c string, other string")).count() == 0


def test_links_are_never_broadcast(spark):
    """A stored table of class names is few bytes and much memory, and Spark goes by the bytes."""
    from siftwell.sources.stored import stored

    links = stored(spark.range(1000).selectExpr("0 AS g", "CONCAT('t', id % 10) AS c", "CONCAT('t', id % 9) AS other"))
    members = stored(spark.range(10).selectExpr("0 AS g", "CONCAT('t', id) AS c", "id AS n", "id AS r"))
    assert "Broadcast" not in keepfirst.reached(members, links)._jdf.queryExecution().executedPlan().toString()


def test_early_reasons_of_pages_are_computed_once(spark):
    """A condition on a stored reason doesn't hold the page's text expression again."""
    pages = catalogue._cascade_pages(spark, "/root/testdata/sf0.001")
    plan = dedup.cascade(pages, "digest", catalogue.YEAR)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan
