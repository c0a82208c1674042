"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is a sequence of words (runs of letters, lower-cased); a word is its letters between two border marks, so a character's context
never reaches over a border and a word's probability is a constant of the model. Each language's n-grams of every order are kept with
their probabilities in arrays sorted by hash. The language with the lowest cross-entropy per character wins; a text whose winner is far
from what training words of that language look like is rejected.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, annotate, col, free_name, slices

ORDER = 4
#: A text is rejected if its cross-entropy is so many standard deviations of calibration texts of its length above their mean ...
REJECT_SIGMAS = 8.0
#: ... and by this share of the mean, since topics differ.
REJECT_MARGIN = 0.15
#: Characters beyond which a longer text's cross-entropy isn't expected to stray less; characters of evidence in a score.
STEADY, EVIDENCE = 400, 30
#: Words that a worker remembers.
MEMORY = 100_000
#: Texts of a language that are kept from its counts, for calibration: one distinct text in CALIBRATION_SHARE, and about CALIBRATION_TEXTS
#: at most. A language of fewer than FEW_TEXTS keeps none; it is calibrated on texts that were counted, with twice the margin.
CALIBRATION_SHARE, CALIBRATION_TEXTS, FEW_TEXTS = 10, 2_000, 100
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_EDGE = "\x02"
_BASE = np.uint64(0x9E3779B97F4A7C15)

PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("n_chars", T.LongType()), T.StructField("rejected", T.BooleanType())])


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words in one array of code points, a border mark before and after each; position in its word and number of the word for each."""
    flat = np.frombuffer((_EDGE + (_EDGE * 2).join(words) + _EDGE).encode("utf-32-le"), np.uint32).astype(np.uint64) if len(words) else np.empty(0, np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat, np.arange(len(flat)) - starts, np.repeat(np.arange(len(words)), sizes)


def _rolled(flat: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0 .. order: 64-bit hashes of the k characters that end at each position."""
    out = [np.zeros(len(flat), np.uint64)]
    for k in range(1, order + 1):
        before = np.zeros_like(out[-1])
        before[1:] = out[-1][:-1]
        out.append(before * _BASE + flat + np.uint64(1))
    return out


def word_grams(word: str, order: int = ORDER) -> list[str]:
    """What a model counts of a word: all runs of ``order`` characters, border marks included, and shorter ones at its beginning."""
    w = _EDGE + word + _EDGE
    return [w[i : i + order] for i in range(len(w) - order + 1)] + [w[:k] for k in range(2, min(order, len(w) + 1))]


def _hashed(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, the same as that of a running n-gram."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = h * _BASE + column + np.uint64(1)
    return h


def gram_counts(grams: dict[str, int], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1 .. order, of the distinct n-grams: hash, hash of the context, hash without the first character, count.

    Only the highest order and n-grams at a word's beginning count occurrences; all others count the distinct characters before them.
    """
    out, longer = [], np.empty((0, order + 1), np.uint64)
    by_size: dict[int, list[str]] = defaultdict(list)
    for g in grams:
        by_size[len(g)].append(g)
    for k in range(order, 0, -1):
        own = np.frombuffer("".join(by_size[k]).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, k)
        n = np.concatenate([np.fromiter((grams[g] for g in by_size[k]), np.int64, len(own)), np.ones(len(longer), np.int64)])
        codes = np.concatenate([own, longer[:, 1:]])
        kinds, first, which = np.unique(_hashed(codes), return_index=True, return_inverse=True)
        longer = codes[first]
        out.append((kinds, _hashed(longer[:, :-1]), _hashed(longer[:, 1:]), np.bincount(which, n, len(kinds)).astype(np.int64)))
    return out[::-1]


class Model:
    """Interpolated Kneser-Ney models of several languages over one set of n-grams.

    For each order: n-gram hashes, sorted, with the log probability of each in every language, and context hashes, sorted, with log
    back-off weights. An n-gram that a language lacks has its backed-off probability filled in, so a lookup serves all languages.
    """

    def __init__(self, grams: dict[str, dict[str, int]], order: int = ORDER):
        self.order, self.languages = order, sorted(grams)
        counts = [gram_counts(grams[x], order) for x in self.languages]
        self.grams, self.contexts = [], []
        self.floor = np.array([-np.log(len(c[0][0]) + 1.0) for c in counts])
        for k in range(1, order + 1):
            level = [c[k - 1] for c in counts]
            grams = np.unique(np.concatenate([x[0] for x in level]) if level else np.empty(0, np.uint64))
            contexts = np.unique(np.concatenate([x[1] for x in level]) if level else np.empty(0, np.uint64))
            back = np.zeros((len(contexts), len(level)))
            shape = np.zeros((len(grams), 2), np.uint64)
            for x in level:
                shape[np.searchsorted(grams, x[0])] = np.stack(x[1:3], 1)
            own = np.full((len(grams), len(level)), 0.0)
            for j, (g, c, _, n) in enumerate(level):
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                at = np.searchsorted(contexts, c)
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    back[:, j] = np.where(total > 0, np.log(d * kinds / total), 0.0)
                own[np.searchsorted(grams, g), j] = (n - d) / total[at]
            self.contexts.append((contexts, back))
            lower = self._level(k - 1, shape[:, 1]) if k > 1 else np.broadcast_to(self.floor, own.shape)
            weight = back[np.searchsorted(contexts, shape[:, 0])] if len(grams) else back[:0]
            self.grams.append((grams, np.log(own + np.exp(weight + lower))))
        self.mean, self.noise, self.margin, self.sigmas = np.zeros(len(self.languages)), np.full(len(self.languages), np.inf), np.zeros(len(self.languages)), 0.0
        self.known: dict[str, int] = {}  # words that were looked up before -> their row
        self.rows = np.empty((0, len(self.languages)))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": self.rows[:0]}

    def _level(self, k: int, gram: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams that are known at this order."""
        return self.grams[k - 1][1][np.searchsorted(self.grams[k - 1][0], gram)]

    def log_probability(self, words: Sequence[str]) -> np.ndarray:
        """Of each word in each language, its end mark included."""
        flat, place, owner = _codes(words)
        h = _rolled(flat, self.order)
        at = np.flatnonzero(place > 0)
        out = np.zeros((len(at), len(self.languages)))
        open_ = np.arange(len(at))
        for k in range(self.order, 0, -1):
            mine = open_[place[at[open_]] >= k - 1]
            i = at[mine]
            grams, p = self.grams[k - 1]
            spot = np.minimum(np.searchsorted(grams, h[k][i]), max(0, len(grams) - 1))
            hit = grams[spot] == h[k][i] if len(grams) else np.zeros(len(i), bool)
            out[mine[hit]] += p[spot[hit]]
            contexts, back = self.contexts[k - 1]
            rest, i = mine[~hit], i[~hit]
            spot = np.minimum(np.searchsorted(contexts, h[k - 1][i - 1]), max(0, len(contexts) - 1))
            seen = contexts[spot] == h[k - 1][i - 1] if len(contexts) else np.zeros(len(i), bool)
            out[rest[seen]] += back[spot[seen]]
            left = np.ones(len(at), bool)
            left[mine[hit]] = False
            open_ = open_[left[open_]]
        out[open_] += self.floor
        sums = np.zeros((len(words), len(self.languages)))
        for j in range(len(self.languages)):
            sums[:, j] = np.bincount(owner[at], out[:, j], len(words))
        return sums

    def sums(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text (end marks count), and its log probability in each language."""
        chars, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        counted = [Counter(text_words(t)) for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.rows = {}, self.rows[:0].copy()
        new = list(set().union(*counted).difference(self.known))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, self.log_probability(part)])
        for i, c in enumerate(counted):
            if c:
                n = np.fromiter(c.values(), np.int64, len(c))
                chars[i] = n @ np.fromiter((len(w) + 1 for w in c), np.int64, len(c))
                total[i] = n @ self.rows[[self.known[w] for w in c]]
        return chars, total

    def calibrate(self, stats: dict[str, tuple[float, float, float, float, float, float]], sigmas: float, margins: dict[str, float]) -> None:
        """Mean cross-entropy by language, and how it strays with a text's length, from sums over texts with letters: texts, characters,
        their bits, and w, w * e, w * e * e of each text's cross-entropy e and its characters w, STEADY at most."""
        self.sigmas = sigmas
        for j, name in enumerate(self.languages):
            n, chars, bits, w, we, wee = stats.get(name, (0,) * 6)
            self.margin[j] = margins.get(name, 0.0)
            if n > 1:
                self.mean[j] = bits / chars
                self.noise[j] = np.sqrt(max(0.0, wee - 2 * self.mean[j] * we + self.mean[j] ** 2 * w) / n)

    def predict(self, texts: Sequence[str | None]) -> list[dict]:
        """Language, its share of the evidence, cross-entropy for each character, characters and rejection of each text.

        The evidence is that of at most EVIDENCE characters, so that a score of nearly 1 needs a clear text. Of languages that tie the
        first in order of names wins.
        """
        out, (chars, total) = [], self.sums(texts)
        for n, x in zip(chars.tolist(), total, strict=True):
            if not n or not self.languages:
                out.append({"lang": UNKNOWN, "score": 0.0, "entropy": None, "n_chars": n, "rejected": True})
                continue
            entropy = -x / n
            best = int(np.argmin(entropy))
            limit = self.mean[best] * (1 + self.margin[best]) + self.sigmas * self.noise[best] / np.sqrt(min(n, STEADY))
            score = 1 / np.exp((entropy[best] - entropy) * min(n, EVIDENCE)).sum()
            out.append({"lang": self.languages[best], "score": float(score), "entropy": float(entropy[best]), "n_chars": n, "rejected": bool(entropy[best] > limit)})
        return out


_COUNTED = pa.schema([("l", pa.string()), ("g", pa.string()), ("n", pa.int64())])


def count_grams(train: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(l, g, n): how often each language's words hold each n-gram that a model counts. Tasks add up what they see before the shuffle."""

    def flush(words: Counter) -> pa.RecordBatch:
        grams: Counter = Counter()
        for (name, w), n in words.items():
            for g in word_grams(w, order):
                grams[name, g] += n
        return pa.RecordBatch.from_pydict({"l": [k[0] for k in grams], "g": [k[1] for k in grams], "n": list(grams.values())}, _COUNTED)

    def count(batches):
        words: Counter = Counter()
        for b in slices(batches, 0):
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(text_words(t)).items():
                    words[name, w] += n
                if len(words) > MEMORY:
                    yield flush(words)
                    words.clear()
        yield flush(words)

    rows = train.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(text), col(lang))
    return rows.mapInArrow(count, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, calibration_texts: int = CALIBRATION_TEXTS, sigmas: float = REJECT_SIGMAS, margin: float = REJECT_MARGIN) -> Model:
    """Fit on all rows with a text and a language; no such row gives a model that calls everything ``und``.

    n-grams are counted in Spark over all texts but those that calibrate, and the tallies, as many as an alphabet has runs of ``order``
    characters, are collected; so are six sums a language. Distinct texts chosen by hash calibrate: one in CALIBRATION_SHARE of each
    language, at most about ``calibration_texts`` of it; they stay in their tasks. Texts are never collected. A language whose texts hold
    no letter rejects nothing.
    """
    usable = train.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(text).alias("t"), col(lang).alias("l")).withColumn("h", F.xxhash64("t", "l"))
    sizes = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = {name: min(1 / CALIBRATION_SHARE, calibration_texts / n) if n >= FEW_TEXTS else 0.0 for name, n in sizes.items()}
    told = train.sparkSession.createDataFrame([(name, int(x * (1 << 30)), not x) for name, x in share.items()], "l string, below long, few boolean")
    usable = usable.join(F.broadcast(told), "l").withColumn("aside", F.pmod("h", F.lit(1 << 30)) < F.col("below"))
    learned: dict[str, dict[str, int]] = {name: {} for name in sizes}
    got = count_grams(usable.where(~F.col("aside")), "t", "l", order).toArrow()
    for name, g, n in zip(*(got.column(i).to_pylist() for i in range(3)), strict=True):
        learned[name][g] = n
    model = Model({name: dict(sorted(grams.items())) for name, grams in learned.items() if grams}, order)
    shared = Shared(train.sparkSession, model)

    def measure(batches):
        model = shared.build(lambda model: model)
        for b in slices(batches, 1):
            chars, total = model.sums(b.column(1).to_pylist())
            place = {name: j for j, name in enumerate(model.languages)}
            at = np.array([place.get(x, -1) for x in b.column(0).to_pylist()], np.int64)
            good = np.flatnonzero((at >= 0) & (chars > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), pa.array(chars[good].astype(np.float64)), pa.array(-total[good, at[good]])], names=["l", "chars", "bits"])

    texts = usable.where(F.col("aside") | F.col("few")).dropDuplicates(["l", "h"]).select("l", "t")
    e, w = F.col("bits") / F.col("chars"), F.least("chars", F.lit(float(STEADY)))
    sums = texts.mapInArrow(measure, "l string, chars double, bits double").groupBy("l").agg(F.count("*"), F.sum("chars"), F.sum("bits"), F.sum(w), F.sum(w * e), F.sum(w * e * e))
    model.calibrate({r[0]: tuple(r)[1:] for r in sums.collect()}, sigmas, {name: margin if x else 2 * margin for name, x in share.items()})
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", result: str | None = None, keep: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """docs with a struct column (lang, score, entropy, n_chars, rejected), and that column's name.

    Null texts and texts without a letter are ``und``, score 0, rejected. Only the text is looked at, however long, and read as a whole.
    Repeated rows come out as often as they go in; an empty frame gives an empty one. No shuffle.
    """
    shared, name = Shared(docs.sparkSession, model), free_name(docs.columns, result or "language")
    shape = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("n_chars", pa.int64()), ("rejected", pa.bool_())])

    def build():
        model = shared.build(lambda model: model)

        def run(raw):
            texts = raw.cast(pa.large_string() if pa.types.is_large_binary(raw.type) else pa.string())
            return pa.array([x for at in range(0, len(texts), 500) for x in model.predict(texts[at : at + 500].to_pylist())], shape)

        return run

    return annotate(docs, text, T.StructField(name, PREDICTION), build, keep), name
