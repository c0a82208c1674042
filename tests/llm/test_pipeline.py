"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from tokenizers import Tokenizer

from siftwell.llm import decontam
from siftwell.llm.queries import tokenizer_path
from siftwell.llm.resemblance import jaccard, shingle_set

from .helpers import prose
from .test_operators import language_rows

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string, contamination string, kept_text string, tokens int, n_lines int, text_before int"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    passage = prose(rng, 60, 60)
    clean = [(i * 3 + "abc".index(lang[0]), t, lang) for i, t, lang in language_rows(40, 3)]
    rows = [*clean, (1000, clean[0][1], "aa"), (1001, "12 34 .. !!", "aa"), (1002, None, "aa"), (1003, "", None), (1004, clean[4][1] + "\n" + passage, "bb"), (1005, clean[5][1] + "\n" + clean[7][1], "cc")]
    long_text = language_rows(1, 9)[0][1].split() * 3
    rows += [(1009, " ".join(long_text), "aa"), (1010, " ".join([*long_text[:50], "abcd", *long_text[51:]]), "aa")]
    item = " ".join(clean[9][1].split()[2:18])
    folder = tmp_path_factory.mktemp("planted")
    full = [(d, t, lang, "src", len(t) if t is not None else None, "own", "own", "own", 7, 7, 7) for d, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), {d: t for d, t, _ in rows}, clean[9][0], item


def test_stages(spark, planted):
    folder, texts, hit, item = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [set(texts)]
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns, name
        after = {r.doc_id: r for r in docs.collect()}
        assert all(r.language == "own" and r.tokens == 7 and r.text_before == 7 for r in after.values())
        gone = set(before) - set(after)
        if name == "language_id":
            assert gone == {1001, 1002, 1003}
        elif name == "line_dedup":
            assert {1000, 1005} <= gone and after[1004].text == texts[1004].split("\n", 1)[1] and after[1004].n_chars == len(after[1004].text)
            assert all(after[d].text == texts[d] for d in after if d < 1000)
        elif name == "simhash_near_dedup":
            sets = {d: shingle_set(r.text.encode()) for d, r in before.items()}
            assert gone == {d for d in before if any(e < d and jaccard(sets[d], sets[e]) >= 0.8 for e in before)} and 1010 in gone
        else:
            rule = {d for d, r in before.items() if (m := decontam.Matcher([("1", item.encode())]).match(r.text.encode())) and 0 < (n := sum(s["end"] - s["start"] for s in m["spans"])) and 20 * n >= m["n_words"]}
            assert gone == rule == {hit}
        seen.append(set(after))
    last = pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.columns[: len(columns)] == columns and "_tokens" in last.columns
    told = Tokenizer.from_file(tokenizer_path())
    assert all(r.round_trip and r.n_tokens == len(r["_tokens"]) > 0 and r["_tokens"] == told.encode(r.text, add_special_tokens=False).ids for r in last.collect())
    assert {r.doc_id for r in pipeline.run(spark, folder).select("doc_id").collect()} == seen[-1]


def test_stages_take_empty_tables(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
