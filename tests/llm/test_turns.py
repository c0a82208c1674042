"""Conversation repair against its SQL and against all edits tried by recursion."""

import random
from functools import lru_cache

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.llm import turns, turns_sql

from .helpers import frame

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def least_edits(rows):
    """(cost, audit) of the least edits among the cheapest, by trying all; rows are (initial, fault)."""

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in (0, 3) else []
        give = next(r for r in "ua" if (q, r) in NEXT)
        if inserted < 3:
            c, a = best(i, NEXT[q, give], inserted + 1)
            found.append((c + 3, "I" + a))
        if i < len(rows):
            role, wrong = rows[i]
            c, a = best(i + 1, q, 0)
            found.append((c + 4, "D" + a))
            if wrong in ("", "truncated"):
                more = 3 if wrong else 0
                if (q, role) in NEXT:
                    c, a = best(i + 1, NEXT[q, role], 0)
                    found.append((c + more, "K" + a))
                c, a = best(i + 1, NEXT[q, give], 0)
                found.append((c + 3 + more, "R" + a))
        return min(found, default=(10**6, ""))

    return best(0, 0, 0)


def test_layers_find_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [(rng.choice("suuaat"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 9))]
        found = turns.layers(rows, (0, turns.NEVER, turns.NEVER, 0), 0)
        edits, _, end = turns.trace(rows, found, 0, True)
        assert (len(found) - 1, edits) == least_edits(rows) and end in (0, 3)


def test_layers_stay_thin():
    rng = random.Random(5)
    rows = [(rng.choice("sua"), rng.choice(["", "truncated", "blank"])) for _ in range(4000)]
    assert sum(map(len, turns.layers(rows, (0, turns.NEVER, turns.NEVER, 0), 0))) <= 4 * 4001
    for end in range(4):
        assert len(turns.layers(rows, [0 if q == end else turns.NEVER for q in range(4)])) <= 7 * 4000 + 64


def chats(seed=1, hot=400):
    """Conversations with gaps, null and repeated turns, null and odd roles and texts; one of them holds most rows."""
    rng = random.Random(seed)
    says = ["Yes.", "No!", "and so", "", " \n", None, "Why?", "Öl.", "a" * 500 + "."]
    rows = []
    for conv in [*range(40), None]:
        t = 0
        for _ in range(rng.randint(1, 9)):
            t += rng.choice([1, 1, 1, 2])
            rows.append((conv, rng.choice([t, t, t, t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(says) if rng.random() < 0.6 else f"{rng.random()}."))
    rows += [(77, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"text {rng.randint(0, 200)}.", "open"])) for t in range(hot)]
    return rows + [rows[3], rows[3], rows[-1]]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def told(rows, report, digests):
    hashes = {r["c"]: r["sha256"] for r in digests.collect()}
    return {r["c"]: (*(r[c] for c in COLUMNS), hashes[r["c"]]) for r in report.collect()}


@pytest.mark.parametrize("piece", [2, 7, turns.PIECE])
def test_repair_equals_sql_for_pieces_of_any_size(spark, piece):
    rows = chats()
    df = frame(spark, rows, "conv_id long, turn long, role string, text string")
    fixed, report = turns.repair(turns.damaged(turns.normal(df)), piece)
    got = told(rows, report, turns.digests(fixed))
    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})
    con.register("conversations", table)
    want = {r[0]: r[1:] for r in con.execute(turns_sql.SQL).fetchall()}
    gone = {c for c in want if c not in got}
    assert {c: v for c, v in want.items() if c not in gone} == got
    assert all(want[c][:-1] == (0, 0, 0, 0, 0, 0, "") for c in gone) and len(got) > 35
    assert fixed.where("not whole").count() > (100 if piece == 2 else 1)


def test_real_turns_and_other_names(spark):
    rows = [("x", 2, "assistant", "Hello.", 1), ("x", 1, "user", "Hi!", 1), ("x", 3, "assistant", "Once more.", 1), ("x", 3, "assistant", "Once more.", 1)]
    df = frame(spark, rows, "`the conv` string, n long, `r.r` string, C string, part int")
    fixed, report = turns.repair(turns.normal(df, "the conv", "n", "r.r", "C"))
    r = report.first()
    assert (r["gaps"], r["duplicate"], r["cost"], r["audit"]) == (0, 1, 7, "KKIKD") or (r["cost"], r["audit"]) == (7, "KKIKD")
    lines = fixed.orderBy("part", "seq").select(F.explode("turns").alias("t")).select("t.*").collect()
    assert [(x["role"], x["text"]) for x in lines if x["edit"] != "D"] == [("user", "Hi!"), ("assistant", "Hello."), ("user", ""), ("assistant", "Once more.")]


def test_empty_table(spark):
    fixed, report = turns.repair(turns.normal(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert report.count() == 0 and turns.digests(fixed).count() == 0
