"""Conversations: damage for tests, faults of turns, and the cheapest edits that give each conversation a legal order of roles.

Legal are the initials (s?(ua)+)?. The automaton has four states: at the beginning, after s, after u, after a; the first and the last accept.
Costs are found in layers: layer c holds for each turn the bits of the states from which the rest can be made legal at cost c and no less.
A turn's states lie within few layers of each other, so each turn has bits in few layers and all layers together are as long as the
conversation. The bits then tell, from the first turn on, which edit is the least in ASCII among the cheapest.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks. One that lies inside a
task, and is short, is repaired there. All others are cut into pieces of at most PIECE rows: a piece is summed up as a matrix of costs from
state to state, matrices are folded from the last piece to the first, and each piece is traced with what lies behind it known.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows, and characters of text, that a piece of a conversation holds at most (one row at least).
PIECE, PIECE_CHARS = 4096, 8 << 20
NEVER = 1 << 40
#: Layers within which all states of a turn are reached that are reached at all: two inserted turns and a deletion apart, with room.
SPREAD = 16
_START, _S, _U, _A = range(4)
_NEXT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}}
#: The one role that may be inserted, or given, in each state.
_GIVEN = ("u", "u", "a", "u")
_NAMES = {"u": "user", "a": "assistant"}
_BEFORE = {r: [sum(1 << q for q, p in to.items() if bits >> p & 1) for bits in range(16)] for r, to in _NEXT.items()}
_BEFORE_GIVEN = [_BEFORE["u"][bits] | _BEFORE["a"][bits] for bits in range(16)]
_BLANK, _WHOLE = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_NOTHING: dict[int, int] = {}

Turn = tuple[str, str]  # initial of the role, fault


def fault(text: str, seen: bool) -> str:
    """blank, duplicate, truncated or nothing: the first that holds."""
    return "blank" if not _BLANK.search(text) else "duplicate" if seen else "" if _WHOLE.search(text) else "truncated"


def layers(turns: Sequence[Turn], goal: Sequence[int], until: int | None = None) -> list[dict[int, int]]:
    """layers[c][i]: bits of the states at turn i whose cheapest way on costs c more than the least of ``goal``, the costs of the states
    behind the last turn. Ends at the layer that holds state ``until`` at the first turn, or when no layer adds any."""
    n, least = len(turns), min(goal)
    begin: dict[int, int] = {}
    for q, g in enumerate(goal):
        if g < NEVER:
            begin[g - least] = begin.get(g - least, 0) | 1 << q
    if not begin:
        return []
    found: list[dict[int, int]] = []
    seen, first, high, last = [0] * (n + 1), [NEVER] * (n + 1), n, max(begin)
    while True:
        c = len(found)
        here: dict[int, int] = {}
        l3, l4, l6 = (found[c - x] if c >= x else _NOTHING for x in (3, 4, 6))
        for i in range(high, -1, -1):
            bits = _BEFORE_GIVEN[l3.get(i, 0)]
            if i == n:
                bits |= begin.get(c, 0)
            else:
                role, wrong = turns[i]
                bits |= l4.get(i + 1, 0)
                if wrong in ("", "truncated"):
                    kept, given = (l3, l6) if wrong else (here, l3)
                    if role in _BEFORE:
                        bits |= _BEFORE[role][kept.get(i + 1, 0)]
                    bits |= _BEFORE_GIVEN[given.get(i + 1, 0)]
            bits &= ~seen[i]
            if bits:
                here[i] = bits
                seen[i] |= bits
                if first[i] == NEVER:
                    first[i] = c
            elif not seen[i]:
                break  # turns before it cost no less
        found.append(here)
        while high > 0 and (seen[high] == 15 or c > first[high] + SPREAD):
            high -= 1
        if (until is not None and seen[0] >> until & 1) or (c > last and not any(found[-SPREAD:])):
            return found


def cost_of(found: list[dict[int, int]], state: int) -> int:
    """The layer that holds this state at the first turn."""
    return next((c for c, bits in enumerate(found) if bits.get(0, 0) >> state & 1), NEVER)


def trace(turns: Sequence[Turn], found: list[dict[int, int]], state: int, ends: bool) -> tuple[str, str, int]:
    """(edits, roles given, last state): the least edits in ASCII among the cheapest from ``state`` on. Edits are D, I, K and R; roles given
    has a letter for each I and R. Where the conversation goes on behind these turns, the next piece decides about insertions between."""
    n, i, c = len(turns), 0, cost_of(found, state)
    has = lambda c, i, q: c >= 0 and found[c].get(i, 0) >> q & 1
    edits, given = [], []
    while i < n or (ends and c > 0):
        wrong, role = (turns[i][1], turns[i][0]) if i < n else ("end", "")
        extra, free = TRUNCATED if wrong == "truncated" else 0, wrong in ("", "truncated")
        new = _GIVEN[state]
        to = _NEXT[new][state]
        if i < n and has(c - DELETE, i + 1, state):
            edits.append("D")
            i, c = i + 1, c - DELETE
        elif has(c - INSERT, i, to):
            edits.append("I")
            given.append(new)
            c, state = c - INSERT, to
        elif free and state in _NEXT.get(role, _NOTHING) and has(c - extra, i + 1, _NEXT[role][state]):
            edits.append("K")
            i, c, state = i + 1, c - extra, _NEXT[role][state]
        else:
            edits.append("R")
            given.append(new)
            i, c, state = i + 1, c - REROLE - extra, to
    return "".join(edits), "".join(given), state


def repaired(rows: Sequence[tuple], faults: Sequence[str], edits: str, given: str) -> list[tuple]:
    """(turn, role, text, fault, edit) of all rows, deleted ones too, and of inserted ones (no turn, no text)."""
    out, i, names = [], 0, iter(given)
    for e in edits:
        if e == "I":
            out.append((None, _NAMES[next(names)], "", "", e))
        else:
            t, role, text = rows[i]
            out.append((t, _NAMES[next(names)] if e == "R" else role, text, faults[i], e))
            i += 1
    return out


def summary(turns: Sequence, initials: Sequence[str], faults: Sequence[str]) -> dict:
    """Counts of a conversation, or of a piece, that add up."""
    told = [t for t in turns if t is not None]
    return {
        "low": min(told, default=None), "high": max(told, default=None), "n_turns": len(set(told)), "blank": sum(f == "blank" for f in faults),
        "duplicate": sum(f == "duplicate" for f in faults), "truncated": sum(f == "truncated" for f in faults),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
    }


_TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("edit", pa.string())]))
_COUNTS = {"low": pa.int64(), "high": pa.int64(), "n_turns": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string()}
_SUMS = "low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
_PIECE_FIELDS = f"part int, seq long, open boolean, turns array<struct<turn: long, role: string, text: string, fault: string, edit: string>>, {_SUMS}, cost long, audit string"


def _nested(lists: list[list[tuple]]) -> pa.Array:
    flat, ends = [x for rows in lists for x in rows], [0]
    for rows in lists:
        ends.append(ends[-1] + len(rows))
    parts = list(zip(*flat, strict=True)) or [()] * 5
    inner = pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, _TURNS.value_type, strict=True)], fields=list(_TURNS.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def _settled(part: int, seq: int, rows: list[tuple]) -> dict:
    """A whole conversation, repaired."""
    seen: set = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    turns = list(zip(initials, faults, strict=True))
    found = layers(turns, (0, NEVER, NEVER, 0), _START)
    edits, given, _ = trace(turns, found, _START, True)
    return {"part": part, "seq": seq, "open": False, "turns": repaired(rows, faults, edits, given), **summary([t for t, *_ in rows], initials, faults), "cost": len(found) - 1, "audit": edits}


def _opened(part: int, seq: int, rows: list[tuple]) -> dict:
    """A piece of a conversation, with faults as far as the piece itself tells them."""
    seen: set = set()
    turns = []
    for t, role, text in rows:
        turns.append((t, role, text, fault(text, (role, text) in seen), None))
        seen.add((role, text))
    return {"part": part, "seq": seq, "open": True, "turns": turns}


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, piece: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, turn, role and text, to one row for each piece. The first and the last conversation of a task may go on
    in other tasks, so their pieces stay open, as do those of long conversations."""
    part, seq, size, out = TaskContext.get().partitionId(), 0, 0, []
    now, rows, chars, is_open = None, [], 0, True
    began = False

    def emit(open_):
        nonlocal seq, rows, chars, size
        out.append((now, (_opened if open_ else _settled)(part, seq, rows)))
        size += chars
        seq, rows, chars = seq + 1, [], 0

    def flush():
        nonlocal out, size
        names = schema.names[1:]
        cols = [pa.array([c for c, _ in out], schema.field(0).type)]
        for f in schema.names[1:]:
            cols.append(_nested([d["turns"] for _, d in out]) if f == "turns" else pa.array([d.get(f) for _, d in out], schema.field(f).type))
        out, size = [], 0
        return pa.RecordBatch.from_arrays(cols, names=[schema.names[0], *names])

    for batch in batches:
        for c, t, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not began or c != now:
                if began and (rows or not is_open):
                    emit(is_open)
                now, is_open, began = c, not began, True
            if rows and (len(rows) >= piece or chars + len(text) > PIECE_CHARS):
                is_open = True
                emit(True)
            rows.append((t, role, text))
            chars += len(text) + len(role)
            if len(out) >= 2000 or size > PIECE_CHARS:
                yield flush()
    if rows:
        emit(True)
    if out:
        yield flush()


def _as_rows(name: str, dtype: str) -> str:
    return f"{name} {dtype}, {_PIECE_FIELDS}"


def pieces(chats: DataFrame, piece: int = PIECE) -> DataFrame:
    """(c, part, seq, open, turns, ...): conversations repaired inside their task, and open pieces of the others, stored in this order."""
    prefix = F.substring("x", 1, 64)  # of long texts only the beginning decides about ranges; the whole text decides inside them
    dealt = chats.repartitionByRange("c", "t", "r", prefix).sortWithinPartitions("c", F.col("t").asc_nulls_first(), "r", "x")
    kind = chats.schema["c"].dataType.simpleString()
    arrow = pa.schema([("c", chats.limit(0).toArrow().schema.field("c").type), ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), ("turns", _TURNS), *_COUNTS.items(), ("cost", pa.int64()), ("audit", pa.string())])
    return store(dealt.mapInArrow(lambda batches: _pieces(batches, arrow, piece), f"c {kind}, {_PIECE_FIELDS}"))


def _faults_across(opened: DataFrame) -> DataFrame:
    """(c, part, seq, starts, roles, faults) of the open pieces, with duplicates of rows that an earlier piece of the conversation holds.

    Rows that repeat inside their piece are told already, so a role and text has at most one row a piece here.
    """
    rows = opened.select("c", "part", "seq", F.posexplode("turns").alias("i", "x")).where(~F.col("x.fault").isin("blank", "duplicate"))
    same = F.sha2(F.concat(F.length("x.role").cast("string"), F.lit(":"), "x.role", "x.text").cast("binary"), 256)
    first = rows.select("c", "part", "seq", "i", same.alias("h"))
    least = first.groupBy("c", "h").agg(F.min(F.struct("part", "seq")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = first.alias("f").join(least.alias("l"), F.col("f.c").eqNullSafe(F.col("l.c")) & (F.col("f.h") == F.col("l.h"))).where((F.col("f.part") != F.col("l.m.part")) | (F.col("f.seq") != F.col("l.m.seq")))
    lists = later.groupBy("f.part", "f.seq").agg(F.collect_list("f.i").alias("again"))
    slim = opened.select("c", "part", "seq", F.col("turns.turn").alias("starts"), F.transform("turns", lambda x: F.substring(x["role"], 1, 1)).alias("roles"), F.col("turns.fault").alias("faults"))
    again = F.coalesce("again", F.array().cast("array<int>"))
    marked = slim.join(lists, ["part", "seq"], "left")
    return marked.select("c", "part", "seq", "starts", "roles", F.transform("faults", lambda f, i: F.when(F.array_contains(again, i), "duplicate").otherwise(f)).alias("faults"))


def _matrices(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = b.to_pydict()
        rows = [summary(*x) for x in zip(got["starts"], got["roles"], got["faults"], strict=True)]
        costs = []
        for roles, faults in zip(got["roles"], got["faults"], strict=True):
            turns = list(zip(roles, faults, strict=True))
            ways = [layers(turns, [0 if q == end else NEVER for q in range(4)]) for end in range(4)]
            costs.append([cost_of(w, q) for q in range(4) for w in ways])
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[f] for r in rows], t) for f, t in _COUNTS.items()), pa.array(costs, pa.list_(pa.int64()))], names=[*names, *_COUNTS, "costs"])


def _goals(group: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each piece, folded from the last one on."""
    group, goal, out = group.sort_values(["part", "seq"]), [0, NEVER, NEVER, 0], []
    for m in group["costs"][::-1]:
        out.append(goal)
        goal = [min(NEVER, *(int(m[4 * q + e]) + goal[e] for e in range(4))) for q in range(4)]
    group["goal"], group["last"] = out[::-1], [False] * (len(group) - 1) + [True]
    group["total"] = goal[_START]
    return group[["part", "seq", "goal", "last", "total"]]


def _traces(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got, ways = b.to_pydict(), []
        for roles, faults, goal, last in zip(got["roles"], got["faults"], got["goal"], got["last"], strict=True):
            turns = list(zip(roles, faults, strict=True))
            found = layers(turns, goal)
            ways.append([trace(turns, found, q, last) if cost_of(found, q) < NEVER else ("", "", q) for q in range(4)])
        parts = [pa.array([[w[k] for w in four] for four in ways], pa.list_(t)) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *parts], names=[*names, "edits", "given", "leads"])


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece begins."""
    group, state, out = group.sort_values(["part", "seq"]), _START, []
    for leads in group["leads"]:
        out.append(state)
        state = int(leads[state])
    group["state"] = out
    return group[["part", "seq", "state"]]


def _joined(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = b.to_pydict()
        done = [repaired([(x["turn"], x["role"], x["text"]) for x in t], f, e, g) for t, f, e, g in zip(got["turns"], got["faults"], got["edits"], got["given"], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("part"), b.column("seq"), _nested(done), b.column("edits")], names=names)


def repair_open(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with their edits, report by conversation) of conversations that lie in several pieces. Between the passes go states and
    costs, a few numbers a piece; what is folded by conversation is one row a piece."""
    kind = opened.schema["c"].dataType.simpleString()
    slim = _faults_across(opened)
    base = f"c {kind}, part int, seq long, starts array<long>, roles array<string>, faults array<string>"
    summed = store(slim.mapInArrow(lambda b: _matrices(b, ["c", "part", "seq", "starts", "roles", "faults"]), f"{base}, {_SUMS}, costs array<long>"))
    goals = summed.select("c", "part", "seq", "costs").groupBy("c").applyInPandas(_goals, "part int, seq long, goal array<long>, last boolean, total long")
    ready = summed.join(goals, ["part", "seq"]).select("c", "part", "seq", "roles", "faults", "goal", "last", "total")
    given = ready.columns
    traced = store(ready.mapInArrow(lambda b: _traces(b, given), f"c {kind}, part int, seq long, roles array<string>, faults array<string>, goal array<long>, last boolean, total long, edits array<string>, given array<string>, leads array<int>"))
    states = traced.select("c", "part", "seq", "leads").groupBy("c").applyInPandas(_entries, "part int, seq long, state int")
    pick = lambda name: F.element_at(name, F.col("state") + 1).alias(name)
    chosen = traced.join(states, ["part", "seq"]).select("part", "seq", "faults", "total", pick("edits"), pick("given"))
    whole = opened.select("c", "part", "seq", "turns").join(chosen.drop("total"), ["part", "seq"]).select("c", "part", "seq", "turns", "faults", "edits", "given")
    names = ["c", "part", "seq", "turns", "audit"]
    fixed = whole.mapInArrow(lambda b: _joined(b, names), f"c {kind}, part int, seq long, {_PIECE_FIELDS.split(', ', 3)[3].split(', low')[0]}, audit string")
    return fixed, _open_report(summed, chosen, kind)


def _open_report(summed: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """Counts added up over pieces; turns and pairs of roles that pieces share at their borders are counted once, and as pairs."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        lows, highs = group["low"].tolist(), group["high"].tolist()
        shared, last = 0, None
        for low, high in zip(lows, highs, strict=True):
            shared += last is not None and not pd.isna(low) and low == last
            last = last if pd.isna(high) else high
        told = [x for x in highs if not pd.isna(x)]
        heads, tails = group["head"].tolist(), group["tail"].tolist()
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(tails, heads[1:]))
        gaps = int(max(told)) - int(min(x for x in lows if not pd.isna(x))) + 1 - (int(group["n_turns"].sum()) - shared) if told else 0
        sums = {f: [int(group[f].sum())] for f in ("blank", "duplicate", "truncated")}
        return pd.DataFrame({"part": group["part"].iloc[:1].tolist(), "seq": group["seq"].iloc[:1].tolist(), "gaps": [gaps], **sums, "illegal": [int(group["illegal"].sum()) + pairs], "cost": [int(group["total"].iloc[0])], "audit": ["".join(group["edits"])]})

    rows = summed.drop("starts", "roles", "faults", "costs").join(chosen.select("part", "seq", "total", "edits"), ["part", "seq"])
    told = rows.groupBy("c").applyInPandas(fold, "part int, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return summed.select("c", "part", "seq").join(told, ["part", "seq"]).drop("part", "seq")


def normal(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, t, r, x): the four columns, whatever their names; null roles and texts are one space."""
    space = F.lit(" ")
    return chats.select(col(conv).alias("c"), col(turn).cast("long").alias("t"), F.coalesce(col(role).cast("string"), space).alias("r"), F.coalesce(col(text).cast("string"), space).alias("x"))


def damaged(rows: DataFrame) -> DataFrame:
    """(c, t, r, x) with faults by a checksum of conversation and turn: one row in twenty each is dropped, emptied, loses its final marks,
    is repeated, or gets the role user. Nulls are one space, in the checksum too."""
    space = F.lit(" ")
    k = F.pmod(F.crc32(F.concat(F.coalesce(F.col("c").cast("string"), space), F.lit(":"), F.coalesce(F.col("t").cast("string"), space)).cast("binary")), F.lit(20))
    text: Column = F.when(k == 1, "").when(k == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x"))
    changed = rows.where(k != 0).select("c", "t", F.when(k == 4, "user").otherwise(F.col("r")).alias("r"), text.alias("x"), F.when(k == 3, 2).otherwise(1).alias("n"))
    return changed.select("c", "t", "r", "x", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy")


def repair(rows: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(turns, report) for ``rows`` (c, t, r, x: conversation, turn, role, text; see normal()).

    ``turns`` (c, part, seq, turns, whole): pieces of conversations in the order of part and seq; ``whole`` tells that a piece is its whole
    conversation. Each element has turn, role, text, fault (blank, duplicate, truncated or empty) and edit: K as it was, R role changed,
    D to be left out, I inserted with an empty text. ``report`` has one row a conversation: gaps, blank, duplicate, truncated, illegal,
    cost, audit.

    Rows go by turn, null turns first, then by role and text, so that repeated rows stand together and all but the first are duplicates;
    a null conversation is one of its own. A text without anything but white space is blank, and then neither duplicate nor truncated.
    A role other than s..., u... and a... is never kept. Without rows there are no conversations.
    """
    first = pieces(rows, piece)
    closed = first.where(~F.col("open"))
    fixed, told = repair_open(first.where("open"))
    turns = closed.select("c", "part", "seq", "turns", F.lit(True).alias("whole")).unionByName(fixed.select("c", "part", "seq", "turns", F.lit(False).alias("whole")))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns"))
    columns = ["c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return turns, closed.withColumn("gaps", gaps).select(columns).unionByName(told.select(columns))


def digests(turns: DataFrame) -> DataFrame:
    """(c, sha256): hash of the repaired ``role:text`` lines of each conversation. What lies in several pieces is hashed piece after piece by
    one task, which holds one piece at a time: a hash can't be put together from parts."""
    lines = F.array_join(F.transform(F.filter("turns", lambda x: x["edit"] != "D"), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    kept = F.exists("turns", lambda x: x["edit"] != "D")
    whole = turns.where("whole").select("c", F.sha2(lines.cast("binary"), 256).alias("sha256"))
    parts = turns.where(~F.col("whole")).select("c", "part", "seq", lines.alias("lines"), kept.alias("kept"))

    def run(batches):
        now, began, state, some, kind = None, False, None, False, None
        for b in batches:
            kind, out = b.schema.field("c").type, []
            for c, text, any_ in zip(b.column("c").to_pylist(), b.column("lines").to_pylist(), b.column("kept").to_pylist(), strict=True):
                if not began or c != now:
                    if began:
                        out.append((now, state.hexdigest()))
                    now, began, state, some = c, True, hashlib.sha256(), False
                if any_:
                    state.update((("\n" if some else "") + text).encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())], names=["c", "sha256"])
        if began:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], names=["c", "sha256"])

    kind = turns.schema["c"].dataType.simpleString()
    return whole.unionByName(parts.repartition("c").sortWithinPartitions("c", "part", "seq").mapInArrow(run, f"c {kind}, sha256 string"))
