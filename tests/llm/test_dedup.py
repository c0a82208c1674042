"""Substring, chunk and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import chunks, lines, suffixes
from siftwell.llm.spans import LAST, merged, removed

from .helpers import corpus, frame, prose

ROWS = corpus()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_suffixes(rows, length=50):
    out = []
    docs = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in docs:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, d))
    for (d, b), (own, _) in zip(docs, rows, strict=True):
        hit = bytearray(len(b) + 1)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                hit[i : i + length] = b"\1" * length
        left = bytes(c for c, h in zip(b, hit, strict=False) if not h)
        out.append((own, len(b), sum(hit), sum(hit[i] and not (i and hit[i - 1]) for i in range(len(b))), sha(left)))
    return sorted(out, key=repr)


def test_suffix_dedup_matches_brute_force(spark):
    assert result(suffixes.digest_columns(frame(spark, ROWS))) == brute_suffixes(ROWS)


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_with_small_lots_and_many_buckets(spark, seed, monkeypatch):
    for name, value in (("GATHER", 50), ("STRINGS", 40), ("SORTED", 30), ("CHUNK", 500)):
        monkeypatch.setattr(suffixes, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = corpus(seed)
        assert result(suffixes.digest_columns(frame(spark, rows))) == brute_suffixes(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_of_one_id_gather_only_their_own_windows(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60)) for i in range(20)]
    rows += [(None, t) for _, t in rows] + [(None, rows[0][1])] * 30 + [(7, rows[3][1])] * 30
    assert result(suffixes.digest_columns(frame(spark, rows))) == brute_suffixes(rows)
    found = suffixes.candidates(suffixes.placed(frame(spark, rows), "text", "doc_id"))
    lists = found.groupBy("d", "v").count().where(f"d = {LAST}").collect()
    assert len(lists) == 20


def test_multikey_quicksort_finds_all_ties():
    rng = random.Random(0)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"c" * 200
    starts = np.arange(len(data) - 50 + 1)
    order, group = suffixes.equal_suffixes(data, starts)
    ties = {}
    for s in starts:
        ties.setdefault(data[s : s + 50], []).append(int(s))
    expected = sorted(v for v in ties.values() if len(v) > 1)
    got = {}
    for o, g in zip(order.tolist(), group.tolist(), strict=True):
        got.setdefault(g, []).append(o)
    assert sorted(sorted(v) for v in got.values()) == expected


def test_every_window_has_one_minimizer_by_content():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 49, 50, 51, 400)]
    own, h, first, offset, count = suffixes.minimizers(texts)
    seen = [(o, f + j) for o, f, c in zip(own.tolist(), first.tolist(), count.tolist(), strict=True) for j in range(c)]
    assert seen == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)]
    alone = suffixes.minimizers([texts[4]])
    assert (alone[1] == h[own == 4]).all() and (alone[3] == offset[own == 4]).all()


def plain_cuts(text):
    """Ends of chunks by the rule itself: a rolling value, byte by byte, that forgets what is 32 bytes back."""
    gear, h, at, ends = [int(x) for x in chunks.gear_table()], 0, 0, []
    for i, c in enumerate(text):
        h = (h * 2 + gear[c]) % 2**32
        if i + 1 - at == chunks.MOST or h >> (32 - chunks.BITS) == 0 and i + 1 - at >= chunks.LEAST:
            ends.append(i + 1)
            at = i + 1
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


def test_cuts_equal_a_byte_by_byte_loop():
    rng = random.Random(11)
    for n in (0, 1, 31, 32, 33, 511, 512, 513, 6000):
        for letters in (b"abcdefgh ", b"a", bytes(range(256))):
            t = bytes(rng.choice(letters) for _ in range(n))
            assert chunks.cuts(t, chunks.gear_table()) == plain_cuts(t)


def test_chunk_dedup_keeps_the_first_of_each_chunk(spark):
    from pyspark.sql import functions as F

    df = frame(spark, ROWS)
    hashes = {r[0]: r[1] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    places = sorted({(LAST if d is None else d, hashes[t or ""], t or "") for d, t in ROWS})
    seen, expected = set(), {}
    for d, _, t in places:
        b, at, spans = t.encode(), 0, []
        for e in plain_cuts(b):
            piece = b[at:e]
            if piece in seen and e - at >= chunks.SHORTEST:
                spans.append((at, e - at))
            seen.add(piece)
            at = e
        left, gone, runs = removed(b, np.array([s for s, _ in spans], np.int64), np.array([n for _, n in spans], np.int64))
        expected[d, t] = (len(b), gone, runs, sha(left))
    want = sorted(((d, *expected[LAST if d is None else d, t or ""]) for d, t in ROWS), key=repr)
    assert result(chunks.digest_columns(df)) == want
    assert sum(w[2] for w in want) > 2000


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(5000))
    gear = chunks.gear_table()

    def pieces(t):
        ends = chunks.cuts(t, gear)
        assert ends[-1] == len(t) and all(chunks.LEAST <= b - a <= chunks.MOST for a, b in zip([0, *ends[:-2]], ends[:-1], strict=True))
        return {t[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    a, b = pieces(text), pieces(text[:2000] + b"inserted" + text[2000:])
    assert len(a - b) <= 6 and len(a) > 40


def brute_lines(rows, hashes, least=lines.LEAST_BYTES):
    """Runs of every length, each compared with all that start before it; blank lines are passed over."""
    visible = lambda x: len(x.translate(None, b" \t\n\r\v\f"))
    places = sorted({(LAST if d is None else d, hashes[t or ""], t or "") for d, t in rows})
    split = {p: p[2].encode().split(b"\n") if p[2] else [] for p in places}
    full = {p: [i for i, x in enumerate(split[p]) if visible(x)] for p in places}
    gone = {p: set() for p in places}
    for n in range(1, max(map(len, full.values())) + 1):
        seen = set()
        for p in places:
            for i in range(len(full[p]) - n + 1):
                at = full[p][i : i + n]
                run = tuple(split[p][j] for j in at)
                if run in seen and sum(map(visible, run)) >= least:
                    gone[p].update(at)
                seen.add(run)
    out = {}
    for p in places:
        g = set(gone[p])
        for j in set(range(len(split[p]))) - set(full[p]) if g else ():
            sides = [max((x for x in full[p] if x < j), default=None), min((x for x in full[p] if x > j), default=None)]
            if all(x is None or x in gone[p] for x in sides):
                g.add(j)
        out[p[0], p[2]] = (len(split[p]), len(g), sum(i - 1 not in g for i in g), sha(b"\n".join(y for i, y in enumerate(split[p]) if i not in g)))
    return sorted(((d, *out[LAST if d is None else d, t or ""]) for d, t in rows), key=repr)


def short_lines(seed):
    rng = random.Random(seed)
    stock = ["ab", "cde", "f g", "hello there", "x" * 15, "y" * 39, "z" * 40, "w" * 100, "", "  "]
    return [(rng.randint(0, 30) if rng.random() < 0.9 else None, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 25)))) for _ in range(50)]


@pytest.mark.parametrize("rows", [ROWS, short_lines(7), short_lines(8)], ids=["corpus", "short lines", "more short lines"])
def test_line_dedup_matches_brute_force(spark, rows):
    from pyspark.sql import functions as F

    df = frame(spark, rows)
    hashes = {r[0]: r[1] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    want = brute_lines(rows, hashes)
    assert result(lines.digest_columns(df)) == want
    assert sum(w[2] for w in want) > 50


def test_runs_of_three_short_lines_pass_over_blank_lines(spark):
    run = ["a" * 14, "b" * 14, "c" * 13]
    rows = [(1, "\n".join(run)), (2, "x\n\n" + "\n\n".join(run) + "\nend"), (3, "\n".join(run[:2]) + "\nz")]
    got = {r.doc_id: bytes(r.kept_text).decode() for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "x\n\nend", 3: rows[2][1]}


def test_a_very_long_text_and_shortest_windows(spark):
    rng = random.Random(3)
    long_text = "\n".join(prose(rng, 6, 6) for _ in range(20_000))
    rows = [(1, long_text), (2, "own line of forty visible bytes, more or less, yes\n" + long_text)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.n_runs) for r in lines.digest_columns(frame(spark, rows)).collect()}
    assert got[2] == (20_001, 20_000, 1)
    ahead, back, wide = lines.windows(np.array([10, 40, 5, 35, 1]), 40)
    assert ahead.tolist() == [2, 1, 2, 0, 0] and back.tolist() == [0, 1, 2, 2, 3] and wide.tolist() == [True] * 5


def test_short_lines_go_only_in_longer_runs(spark):
    rows = [(1, "aaa\nbbb\n" + "c" * 30 + "\n" + "d" * 20), (2, "aaa\nother\n" + "c" * 30 + "\n" + "d" * 20 + "\nend"), (3, "aaa\nx")]
    got = {r.doc_id: bytes(r.kept_text).decode() for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "aaa\nother\nend", 3: "aaa\nx"}


@pytest.mark.parametrize("op", [suffixes.dedup_substrings, chunks.dedup_substrings, lines.dedup_lines])
def test_empty_tables_and_clashing_names(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    schema = "doc_id long, text string, d long, t string, `k0` int, `a.b` string, n_bytes int, kept_text string"
    df = spark.createDataFrame([(1, "x" * 300, 5, "t", 7, "ab", 9, "own"), (2, "x" * 300, 6, None, None, None, None, None), (3, None, 1, "", 1, "", 1, "")], schema)
    got = {r["doc_id"]: r.asDict() for r in op(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["d"] == 5 and got[1]["a.b"] == "ab" and got[1]["k0"] == 7 and got[1]["n_bytes"] == 9 and got[1]["kept_text"] == "own" and got[2]["t"] is None
    assert bytes(got[2]["_kept_text"]) == b"" and len(got[1]["_kept_text"]) in (300, 256, 32, 64, 512, 96) or op is chunks.dedup_substrings


def test_merged_spans():
    a, e = merged(np.array([5, 0, 2, 20]), np.array([3, 4, 3, 1]))
    assert a.tolist() == [0, 20] and e.tolist() == [8, 21]
    assert removed(b"abcdef", np.array([1, 2]), np.array([2, 2])) == (b"aef", 3, 1)


def test_thousands_of_copies_of_one_row(spark):
    """Copies of a row, under one id or none, lose nothing to each other, and cost what they are, not their square."""
    rng = random.Random(9)
    text = prose(rng, 300)
    rows = [(None, text)] * 4000 + [(5, text)] * 4000 + [(7, text), (None, "short")]
    df = frame(spark, rows)
    for module in (chunks, suffixes):
        got = Counter((r["doc_id"], r["n_removed"] > 0) for r in module.digest_columns(df).collect())
        assert got == {(None, True): 4000, (5, False): 4000, (7, True): 1, (None, False): 1}, module


def test_whole_copies_are_no_candidates(spark):
    """What only copies of one text hold needs no partner; their bytes go all the same, and a copy's passages still count for other texts."""
    import random

    from siftwell.llm import suffixes
    from siftwell.llm.spans import placed

    from .helpers import frame, prose

    rng = random.Random(4)
    a, b, part = prose(rng, 120), prose(rng, 90), prose(rng, 30, 30)
    rows = [(2, a), (7, a), (3, a), (None, a), (9, b), (None, b), (None, b), (4, "short"), (5, "short")]
    for by_text, some in ((False, True), (True, False)):
        assert bool(suffixes.candidates(placed(frame(spark, rows), "text", "doc_id"), by_text).count()) == some
    rows += [(8, prose(rng, 20) + part), (1, part + b), (6, part + b)]
    want = {}
    for d, t in rows:
        early = {x.encode()[i : i + 50] for e, x in rows if e is not None and (d is None or e < d) for i in range(len(x.encode()) - 49)}
        raw = t.encode()
        want[d, t] = len({i + k for i in range(len(raw) - 49) if raw[i : i + 50] in early for k in range(50)})
    got = {(r.doc_id, r.text): r.n_removed for r in suffixes.dedup_substrings(frame(spark, rows)).collect()}
    assert got == want
