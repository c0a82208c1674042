"""Filter interactions against their SQL, and with three filters against plain rules."""

import random
from itertools import permutations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from siftwell.llm import filters, queries

from .helpers import frame, prose


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(220):
        t = prose(rng, rng.choice([3, 60, 210, 260]))
        t = rng.choice([t, t, t.upper(), t + " # $ *", "same same " * 300, t, "Copy of this.", None, "", " \t\n"])
        rows.append((i, t, rng.choice(["a", "a", "a", "b", "", None])))
        labels += [(i, rng.choice([0, 1, None]), rng.choice([0, 1]))] * rng.choice([0, 1, 1, 2])
    rows += [(None, "Copy of this.", "a"), (None, "Copy of this.", "a"), (2, "Copy of this.", "b"), (-5, "Copy of this.", "only"), (9, "x " * 300000, "long")]
    return rows, labels


def test_audit_equals_sql(spark):
    rows, labels = corpus()
    docs = frame(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n int, part int")
    got = filters.audit(docs, frame(spark, labels, "doc_id long, quality int, toxic int"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "string", "source": "string"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    want = con.execute(queries.ORACLE_SQL["op12_filter_audit"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall()) and got.count() == 600 * 5


def test_other_filters_and_names(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["short", "x" * 30, "y#", "z" * 40 + "#"]), "p") for i in range(60)]
    docs = frame(spark, rows, "`an id` long, B string, `p.q` string")
    marks = frame(spark, [(i, i % 2, 0) for i in range(60)], "`an id` long, quality int, toxic int")
    got = filters.audit(docs, marks, "B", "an id", "p.q", {"t": F.length("t") < 10, "U": F.col("t").contains("#")}, "C").collect()
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    fails = [{"t": len(t) < 10, "U": "#" in t, "C": first[t] != i} for i, t, _ in rows]
    assert len(got) == 18
    for r in got:
        assert tuple(r["filter_order"]) in set(permutations("tUC"))
        left = [(i, f) for i, f in enumerate(fails) if not any(f[x] for x in r["filter_order"][: r["step"] - 1])]
        x = r["filter_order"][r["step"] - 1]
        out = [i for i, f in left if f[x]]
        assert (r["removed"], r["kept"], r["good_lost"]) == (len(out), len(left) - len(out), sum(i % 2 for i in out))
        assert r["redundant"] == sum(f[x] for f in fails) - len(out) and r["unique_fails"] == sum(f[x] and sum(f.values()) == 1 for f in fails)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filters.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
