"""The registered queries of this subpackage: each applies one operator to its whole table and returns the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, decontam, filters, langid, lines, neighbours, rules, shards, simhash, suffixes, turns, turns_sql, wrappers
from .common import col, spread, table


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found, r = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = col(r)["item_ids"]
    return found.select(
        "doc_id", col(r)["n_words"].alias("n_words"), decontam.hit_words(r).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), decontam.is_contaminated(r).alias("contaminated"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    coded, r = bpe.encode_decode(docs, tokenizer_path(), keep=["doc_id"])
    tokens = col(r)["tokens"]
    return coded.select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(col(r)["decoded"].cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest_columns(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_columns(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = wrappers.main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")), keep=["page_id", "url"])
    return found.select("page_id", "url", col(name).alias("text"), F.length(col(name)).cast("long").alias("n_chars"))


def held_out(key: str = "doc_id"):
    """True for the third of documents that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.fit(docs.where(~held_out()))
    told, r = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return told.select("doc_id", held_out().alias("held_out"), col(r)["lang"].alias("lang_pred"), col(r)["score"].alias("score"), col(r)["rejected"].alias("rejected"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.digest_columns(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = turns.normal(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    fixed, report = turns.repair(turns.damaged(chats))
    known = chats.select(F.col("c").alias("conv_id")).distinct()
    told = report.join(turns.digests(fixed).withColumnRenamed("c", "d"), F.col("c").eqNullSafe(F.col("d"))).drop("d")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return known.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), table(spark, sf_dir, "labels"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = rules.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out()))
    told, name = rules.score(docs, model, keep=["doc_id"])
    return told.select("doc_id", held_out().alias("held_out"), col(name).alias("score"), (col(name) >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_neighbours": op10_neighbours,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality": op13_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: DuckDB SQL by brute force, over every window of every text.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
        places AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows))),
        hits AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.n = x.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM d)),
        f AS (SELECT doc_id, s FROM w JOIN (SELECT k, min(doc_id) AS m FROM w GROUP BY 1) USING (k) WHERE doc_id > m),
        g AS (SELECT doc_id, s, sum(CASE WHEN s - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM f)),
        runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS e FROM g GROUP BY doc_id, i),
        parts AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM runs),
        kept AS (SELECT r.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (a - b) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS k
            FROM parts r JOIN d ON r.doc_id = d.doc_id GROUP BY 1)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op11_conversation_repair": turns_sql.SQL,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
        f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
                'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), FALSE)} AS fails
            FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        failed AS (SELECT doc_id, part, good, toxic, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END) || (CASE WHEN fails.D THEN 'D' ELSE '' END) || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS f FROM f),
        went AS (SELECT part, good, toxic, f, filter_order, coalesce(list_min([instr(filter_order, x) FOR x IN string_split(f, '') IF x <> '']), 6) AS gone FROM failed, orders),
        steps AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
                count(*) FILTER (gone < step AND contains(f, substr(filter_order, step, 1))) AS redundant, count(*) FILTER (f = substr(filter_order, step, 1)) AS unique_fails,
                count(*) FILTER (gone = step AND good = 1) AS good_lost, count(*) FILTER (gone = step AND toxic = 1) AS toxic_lost
            FROM went, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step)
        SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM steps""",
}
