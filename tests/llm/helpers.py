"""Fixture texts and frames of the operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def prose(rng: random.Random, words: int, line: int = 12) -> str:
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    w = [rng.choice(stems) for _ in range(words)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, words, line))


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Clean texts, exact and near copies, shared passages, periodic texts, long words, nulls, blanks, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 150)) for _ in range(25)]
    passage = prose(rng, 70, 70)
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(100 + i, base[i]) for i in range(4)]
    rows += [(200 + i, base[5].replace(" ", "  ", 1) + f"\nline {i}") for i in range(6)]
    rows += [(300 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)) for i in range(3)]
    rows += [(400, "a" * 3000), (401, "a" * 700), (402, "ab" * 900), (403, "x " * 2000), (404, "öä€😀" * 60), (405, "öä€😀" * 40 + "!")]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "A"), (504, "\n\n\n"), (505, "1 2 3"), (506, base[1] + "\n" + base[1])]
    rows += [(0, base[0]), (0, base[9]), (None, base[3]), (None, None), (None, base[3]), (-7, base[4])]
    return rows
