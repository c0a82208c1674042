"""Decontamination, BPE, SimHash, sharding, language ID and neighbours against brute force or known answers."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontam, langid, neighbours, queries, shards, simhash
from siftwell.llm.common import col
from siftwell.llm.components import connected_components

from .helpers import corpus, frame, prose

ROWS = corpus()
CLASH = "doc_id long, text string, contamination string, bpe int, `a.b` int, fingerprint string, shard string, part int"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for k in range(len(x) - n + 1) if n else ():
            win = x[k : k + n]
            for s in range(len(w) - n + 1):
                if w[s : s + n] == win:
                    hit.update(range(s, s + n))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, prose(random.Random(9), 40)), (2, "one two three"), (3, "ÀB c1"), (4, None), (5, "..."), (10, "one two"), (None, "four five six"), (2, "one two three"), (7, " ".join(["la"] * 20)), (8, "B A-")]
DOCS = [(1, "x " + ITEMS[0][1].upper() + " y"), (2, "One,TWO  three one two-three"), (3, "Àb C1 b a four five six"), (4, None), (5, ""), (6, "la " * 30), (7, "nothing here"), (8, " ".join(ITEMS[0][1].split()[3:16]) + " q" * 300), (9, "ÀB\x00C1"), (9, "ÀB\x00C1"), (None, "one two three")]


@pytest.mark.parametrize("pass_windows", [10_000, 12])
def test_decontamination_matches_brute_force(spark, monkeypatch, pass_windows):
    monkeypatch.setattr(decontam, "PIECE", 5 if pass_windows == 12 else 2_000)
    docs = frame(spark, [(*d, "own", 1, 2) for d in DOCS], "doc_id long, text string, _spans string, _ids int, text_key int")
    found, r = decontam.find_contamination(docs, frame(spark, ITEMS, "item_id long, text string"), pass_windows=pass_windows)
    assert {(x["_spans"], x["_ids"], x["text_key"]) for x in found.collect()} == {("own", 1, 2)}
    got = sorted([(x.doc_id, x.text, x.n, x.h, x.i) for x in found.select("doc_id", "text", col(r)["n_words"].alias("n"), decontam.hit_words(r).alias("h"), col(r)["item_ids"].alias("i")).collect()], key=repr)
    assert got == sorted([(d, t, *brute_hits(t, ITEMS)) for d, t in DOCS], key=repr)


def test_decontamination_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    found, r = decontam.find_contamination(frame(spark, DOCS), empty)
    assert found.where(decontam.is_contaminated(r)).count() == 0 and found.count() == len(DOCS)
    assert decontam.find_contamination(spark.createDataFrame([], CLASH), empty)[0].count() == 0


def test_wu_manber_finds_every_pattern():
    rng = random.Random(3)
    w = [rng.choice([b"a", b"b", b"c"]) for _ in range(600)]
    for n in (1, 2, 3, 5):
        patterns = list({tuple(w[i : i + n]) for i in range(0, 200, 7)})
        got = sorted(decontam.WuManber(patterns, n).search(w))
        assert got == sorted((s, p) for s in range(len(w) - n + 1) for p in patterns if tuple(w[s : s + n]) == p)


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    reference = Tokenizer.from_file(path)
    odd = ["<|endoftext|>x<|endoftext|>", "a b  c \n\n d", "it's WE'RE 123abc\t\tx", "\x00\x01", "éﬁ", "ひらがな漢字", "aaaaaaaaaaaaaaaaaaaaaaaaab" * 40, " lead", "trail ", "  "]
    rows = [*ROWS, *((1000 + i, t) for i, t in enumerate(odd))]
    coded, r = bpe.encode_decode(frame(spark, rows), path)
    for x in coded.collect():
        want = reference.encode(x.text or "", add_special_tokens=False).ids
        assert x[r].tokens == want
        assert x[r].decoded == reference.decode(want, skip_special_tokens=False)


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = Counter(b for x in s for h in [xxhash.xxh64_intdigest(x.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(s))


def brute_components(prints):
    ids, root = list(prints), {}
    for i in ids:
        root.setdefault(i, i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [2048, 2])
def test_simhash_components_match_brute_force(spark, bucket):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    long_text = prose(random.Random(4), 3000)
    rows += [(5000 + i, long_text + f" tail{i}") for i in range(12)]
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    got = simhash.near_duplicates(frame(spark, rows), bucket=bucket).collect()
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_golay_keys_meet_for_all_pairs_within_two_bits():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 300).astype(np.uint64)
    for k in range(300):
        flips = rng.choice(64, 2, replace=False)
        fps[k] = fps[k]
        other = fps[k] ^ np.uint64(1 << int(flips[0])) ^ np.uint64(1 << int(flips[1])) if k % 3 else fps[k] ^ np.uint64(1 << int(flips[0]))
        who, keys = simhash.bucket_keys(np.array([fps[k], other]))
        assert set(keys[who == 0]) & set(keys[who == 1])


def test_near_duplicates_edge_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], CLASH)).count() == 0
    rows = [(3, None), (2, ""), (None, " "), (7, "A b"), (8, "a B"), (8, "a B"), (None, "zzz q")]
    got = Counter((x.doc_id, x.component_id) for x in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(3, 2), (2, 2), (None, 2), (7, 7), (8, 7), (8, 7), (None, None)])
    left = simhash.drop_near_duplicates(frame(spark, [(*r, "own", 1) for r in rows], "doc_id long, text string, _gone string, gone int"))
    assert Counter((x.doc_id, x["_gone"], x.gone) for x in left.collect()) == Counter((d, "own", 1) for d in [2, None, 7, None])


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    got = {x.node: x.root for x in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_shards_are_exact_and_gapless(spark):
    df = spark.range(0, 1003, 1, 7).selectExpr("id as doc_id", "concat('t', id) as text", "'own' as shard", "id as part")
    got = shards.shard(df, cell_rows=50).collect()
    assert Counter(x.doc_id for x in got) == Counter(range(1003))
    slots = {s: sorted(x.slot for x in got if x.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} <= {125, 126}
    again = shards.shard(df, cell_rows=50).collect()
    assert sorted(again) == sorted(got)
    assert shards.shard(df, seed=5, cell_rows=50).collect() != got
    assert shards.shard(spark.createDataFrame([], CLASH)).count() == 0


def test_sharding_query_columns(spark, tmp_path):
    rows = [*ROWS, (9_000, "long " * 200_000)]
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_sharding(spark, str(tmp_path)).collect()
    measure = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((d, *measure(t)) for d, t in rows)
    assert {x.law for x in got} == {"rows"} and {x.grown_shard for x in got} == {None}
    slots = {s: sorted(x.slot for x in got if x.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_counts_beyond_the_library_follow_the_same_law(monkeypatch):
    draws = {}
    for limit in (10**9, 10):
        monkeypatch.setattr(shards, "LIBRARY_RANGE", limit)
        rng = np.random.default_rng(4)
        draws[limit] = np.array([shards.hypergeometric(rng, 300, 500, 120) for _ in range(6000)])
    a, b = draws.values()
    assert abs(a.mean() - b.mean()) < 0.3 and abs(a.std() - b.std()) < 0.2 and abs(b.mean() - 45) < 0.2
    rng = np.random.default_rng(5)
    big = np.array([shards.hypergeometric(rng, 3 * 10**10, 5 * 10**10, 8 * 10**9) for _ in range(40)])
    sd = np.sqrt(8e9 * 0.375 * 0.625 * 0.9)
    assert abs(big.mean() - 3e9) < sd and 0.6 * sd < big.std() < 1.5 * sd
    assert shards.draw(rng, np.array([5, 2 * 10**9, 0, 10**9]), 3 * 10**9 + 5).tolist() == [5, 2 * 10**9, 0, 10**9]


def test_shard_places_are_uniform():
    counts = np.array([400, 0, 100, 500])
    caps = shards.shard_sizes(1000, 4)
    rows = np.array([[shards.matrix_row(counts, caps, p, s) for p in range(4)] for s in range(300)])
    assert (rows.sum(2) == counts).all() and (rows.sum(1) == caps).all()
    assert np.abs(rows.mean(0) - np.outer(counts, caps) / 1000).max() < 2


def language_rows(n, seed):
    rng = random.Random(seed)
    letters = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "abcmnoxyz"}
    return [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(40)), lang) for i in range(n) for lang in letters]


def test_language_model_and_rejection(spark):
    train = frame(spark, [*language_rows(40, 1), (0, None, "aa"), (1, "abc", None), (2, "", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    tests = [(i, t, lang) for i, t, lang in language_rows(15, 2)]
    odd = [(900, None, None), (901, "", None), (902, "12 34 !!", None), (903, "ж" * 50 + " щщщ" * 60, None), (904, "١٢", None)]
    told, r = langid.predict(frame(spark, [*tests, *odd], "doc_id long, text string, lang string"), model)
    got = [x.asDict() for x in told.collect()]
    known = [x for x in got if x["doc_id"] < 900]
    assert np.mean([x[r].lang == x["lang"] for x in known]) > 0.98 and not any(x[r].rejected for x in known)
    assert all(0 <= x[r].score <= 1 for x in got)
    assert {x["doc_id"]: (x[r].lang, x[r].rejected) for x in got if x["doc_id"] in (900, 901, 902, 904)} == dict.fromkeys((900, 901, 902, 904), ("und", True))
    assert next(x for x in got if x["doc_id"] == 903)[r].rejected
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    told, r = langid.predict(frame(spark, tests[:3], "doc_id long, text string, lang string"), nothing)
    assert {x[r].lang for x in told.collect()} == {"und"}


class DictionaryModel:
    """Interpolated Kneser-Ney straight from its definition, over dictionaries of strings."""

    def __init__(self, words, order):
        self.order, self.n = order, {k: Counter() for k in range(1, order + 1)}
        before = {k: {} for k in range(1, order)}
        for w, n in words.items():
            padded = "\x02" + w + "\x02"
            for end in range(2, len(padded) + 1):
                for k in range(1, order + 1):
                    if end >= k and (k == order or end == k):
                        self.n[k][padded[end - k : end]] += n
                    elif end > k:
                        before[k].setdefault(padded[end - k : end], set()).add(padded[end - k - 1])
        for k in before:
            for g, kinds in before[k].items():
                self.n[k][g] += len(kinds)

    def p(self, ctx, c):
        if ctx is None:
            return 1 / (len(self.n[1]) + 1)
        k = len(ctx) + 1
        lower = self.p(ctx[1:] if ctx else None, c)
        follow = {g: n for g, n in self.n[k].items() if g[:-1] == ctx}
        if not follow:
            return lower
        ones, twos = (sum(n == x for n in self.n[k].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(follow.values())
        return (max(0, follow[ctx + c] - d) if ctx + c in follow else 0) / total + d * len(follow) / total * lower

    def log_probability(self, word):
        padded = "\x02" + word + "\x02"
        return sum(np.log(self.p(padded[max(0, i - self.order + 1) : i], padded[i])) for i in range(1, len(padded)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_equals_its_definition(order):
    counts = {"aa": {"abab": 3, "abc": 2, "b": 1, "ccab": 4, "bacab": 1, "ca": 2}, "bb": {"xyx": 2, "aby": 1, "y": 5, "yyxab": 1}}
    grams = {}
    for lang, words_ in counts.items():
        grams[lang] = Counter()
        for w, n in words_.items():
            for g in langid.word_grams(w, order):
                grams[lang][g] += n
    model = langid.Model(grams, order)
    asked = ["abab", "b", "zz", "abyx", "ccabxy", "a", "yy", "q", "bacabac"]
    got = model.log_probability(asked)
    for j, lang in enumerate(model.languages):
        brute = DictionaryModel(counts[lang], order)
        assert np.allclose(got[:, j], [brute.log_probability(w) for w in asked], atol=1e-9)
        seen = {c for w in counts[lang] for c in w} | {"\x02"}
        assert all(sum(brute.p(ctx, c) for c in seen) <= 1 + 1e-9 for ctx in ["", "a", "ab"[: order - 1]])


def test_grams_are_counted_over_all_texts(spark):
    rows = [(i, t, lang) for i, t, lang in language_rows(30, 5)]
    want = Counter((lang, g) for _, t, lang in rows for w in langid.text_words(t) for g in langid.word_grams(w))
    got = langid.count_grams(frame(spark, rows, "doc_id long, text string, lang string"), "text", "lang").collect()
    assert {(r.l, r.g): r.n for r in got} == dict(want)


def test_rare_and_hot_languages_still_reject(spark):
    rows = [*language_rows(150, 6), *((10_000 + i, "mnop qrst " * 30, "bb") for i in range(3000)), *((20_000 + i, t.translate(str.maketrans("abcdefgh", "ijkluvwy")), "dd") for i, t, lang in language_rows(20, 7) if lang == "aa")]
    model = langid.fit(frame(spark, rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc", "dd"] and np.isfinite(model.noise).all()
    junk = [(1, "жщ цъъ " * 40), (2, "iжjщ kцl uъ " * 40), (3, "mжnщ oцp qъ " * 40)]
    told, r = langid.predict(frame(spark, junk), model)
    assert all(x[r].rejected for x in told.collect())


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [x for x in got if x.held_out and x.lang is not None and langid.text_words(x.text)]
    assert len(held) > 250 and np.mean([x.lang_pred == x.lang for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert {x.lang_pred for x in got} <= {x.lang for x in got} | {"und"}


def cosines(x, q):
    return (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)


def recall(got, ids, x, queries, k=5):
    """Share of the true k nearest that were found; every query must have k rows, in order, with exact scores."""
    place, hits = {v: i for i, v in enumerate(ids)}, 0
    for q in queries:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, k + 1))
        s = cosines(x, x[place[q]])
        assert all(abs(r.score - s[place[r.vec_id]]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        s[place[q]] = -9
        hits += len({r.vec_id for r in mine} & {ids[i] for i in np.lexsort((ids, -s))[:k]})
    return hits / (k * len(queries))


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[10] = x[0]
    x[20] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    bad = [(50_000, None), (50_050, [0.0] * 24), (50_100, [float("nan")] * 24), (50_150, [None] * 24), (50_200, [float("inf")] + [1.0] * 23), (None, rows[3][1]), rows[7]]
    df = frame(spark, [*rows, *bad], "vec_id long, embedding array<float>")
    for part, substrings in ((4096, None), (7, 4), (4096, 8)):
        got = neighbours.search(df, F.col("vec_id") % 50 == 0, part=part, substrings=substrings).collect()
        assert len(got) == 150 and recall(got, list(range(1500)), x.astype(np.float64), range(0, 1500, 50)) >= 0.95
        assert [r.vec_id for r in sorted(got) if r.query_id == 0][:2] == [10, 20]


def test_outliers_get_all_their_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 16))
    x = np.concatenate([centres[rng.integers(0, 5, 1000)] + 0.01 * rng.normal(size=(1000, 16)), -10 * centres.sum(0)[None], rng.normal(size=(1, 16))])
    ids = [*range(1, 1001), 5000, 5050]
    df = frame(spark, [(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert recall(got, ids, x, [i for i in ids if i % 50 == 0]) >= 0.9


def test_neighbours_of_the_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = queries.op10_neighbours(spark, "/root/testdata/sf0.01").collect()
    rows = df.select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    assert recall(got, ids, x, [i for i in ids if i % 50 == 0]) >= 0.9


def test_neighbours_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>, id int, v int, piece int"
    assert neighbours.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    got = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 1), (1, [0.0, 2.0], 1, 1, 1), (2, [3.0, 3.0], 1, 1, 1)], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in sorted(got)] == [(0, 1, 2, 0.707107), (0, 2, 1, 0.0)]
    got = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 1), (1, [1.0], 1, 1, 1), (2, [1.0, 0.0, 1.0], 1, 1, 1)], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(got)] == [(1, 1.0), (2, 0.707107)]
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 1)], schema), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_bpe", "op3_simhash", "op4_line_dedup", "op5_sharding", "op6_suffix_dedup", "op7_html_text", "op8_language_id", "op9_chunk_dedup", "op10_neighbours"])
def test_queries_return_the_agreed_columns(spark, name):
    columns = {
        "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2": "doc_id n_tokens ids_sha256 decoded_sha256", "op3": "doc_id fingerprint component_id",
        "op5": "doc_id size text_crc32 law shard slot grown_shard", "op6": "doc_id n_bytes n_removed n_spans kept_sha256", "op7": "page_id url text n_chars",
        "op8": "doc_id held_out lang_pred score", "op10": "query_id rank vec_id score", "op4": "doc_id n_lines n_deleted", "op9": "doc_id n_bytes n_removed",
    }
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(columns[name.split("_")[0]].split()) <= set(df.columns)
    assert df.count() == {"op7": 50, "op10": 50}.get(name.split("_")[0], 200)


@pytest.mark.parametrize("memory", [100_000, 3])
def test_words_of_several_pieces_are_encoded_once(monkeypatch, memory):
    from siftwell.llm import bpe
    from siftwell.llm.queries import tokenizer_path

    monkeypatch.setattr(bpe, "MEMORY", memory)
    with open(tokenizer_path(), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    texts = ["so zqxjk, end", "so zqxjk! end", "so zqxjk. It ends; zqxjk", "one two three four five", "so zqxjk, end"]
    whole = [np.concatenate([vocabulary.merge(w.encode()) for w in bpe.regex.findall(bpe.WORD_PATTERN, t)]).tolist() for t in texts]
    asked, plain = [], vocabulary.encode_words
    vocabulary.encode_words = lambda words: asked.extend(words) or plain(words)
    encoder = bpe.Encoder(vocabulary)
    assert [encoder.encode([t])[0].tolist() for t in texts] == whole
    assert memory == 3 or len(asked) == len(set(asked))


def test_short_words_are_merged_together():
    """As each alone is: random bytes, runs of one byte with merges of equal rank, and words of every length up to SHORT."""
    with open(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    rng = random.Random(4)
    words = [bytes(rng.choice(b" etaoinshrdlu") for _ in range(rng.randint(1, bpe.SHORT))) for _ in range(1500)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randint(1, bpe.SHORT))) for _ in range(300)] + [b"a" * n for n in range(1, bpe.SHORT + 1)]
    want = [vocabulary.merge(w) for w in words]
    assert vocabulary.merge_together(words) == want
    vocabulary.merge = None
    assert vocabulary.encode_words(words) == want
