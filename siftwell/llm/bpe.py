"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for each new word. A proposal is the BPE encoding exactly if its tokens encode themselves and every
adjacent pair is compatible: undoing the latest merges on both sides of their border, one after another, never meets a merge that would
have crossed the border first. All adjacent pairs of a block of words are tested at once on arrays; only words with a failing pair are
merged step by step, the short ones of a block together, one merge of each a step.
"""

from __future__ import annotations

import bisect
import heapq
import json
from collections.abc import Iterable, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Shared, annotate, free_name

#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's memory of encoded words holds before it starts anew, and characters that it encodes at a time.
MEMORY, BLOCK_CHARS = 100_000, 1_000_000
#: Bytes up to which a word is merged by rescanning instead of with a heap, and words whose steps are taken together.
SHORT, TOGETHER = 32, 4096
_NEVER = np.int64(1) << 40

ENCODED = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, content: str):
        data = json.loads(content)
        model, symbols = data["model"], byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.texts = [b""] * self.size
        for s, i in ids.items():
            self.texts[i] = raw(s)
        for s, i in self.special.items():
            self.texts[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(2))
        self.rank = np.full(self.size, -1, np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        pair = np.array([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), pair[:, 0], pair[:, 1]
        keys = pair[:, 0] * self.size + pair[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.made, self.byte_id = made, [ids[s] for s, _ in sorted(symbols.items(), key=lambda x: x[1])]
        whole = made[self.compatible(pair[:, 0], pair[:, 1], np.arange(len(made)))]  # tokens that encode themselves
        match = {self.texts[i]: i for i in [*self.byte_id, *whole.tolist()]}
        #: every beginning of a token -> the token, or -1 if it is none itself
        self.reach = {t[:n]: -1 for t in match for n in range(1, len(t))} | match

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        made = np.flatnonzero(self.rank >= 0)
        return {(int(self.left[i]), int(self.right[i])): (int(self.rank[i]), int(i)) for i in made}

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array(self.byte_id, np.int64)

    @cached_property
    def coded(self) -> dict[int, int]:
        """The same with both ids in one integer, and rank and new id in another."""
        if self.size > 1 << 20:
            raise ValueError(f"{self.size} token ids don't fit 20 bits")
        return {a << 20 | b: r << 20 | t for (a, b), (r, t) in self.merges.items()}

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does a border between them survive all merges of rank below limit (default: all)?"""
        good, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NEVER) if limit is None else limit
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = np.where(self.keys[place] == key, self.key_rank[place], _NEVER) < limit
            good[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & (np.maximum(ra, rb) >= 0)  # two single bytes: nothing is left to undo
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            on_left = ra > rb  # of two equal merges the left one was made first, so the right one is undone first
            limit = np.where(on_left, ra, rb + 1)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, reach = [], 0, len(word), self.reach
        while at < n:
            best, stop, end = -1, at + 1, at + 1
            while end <= n and (t := reach.get(word[at:end])) is not None:
                if t >= 0:
                    best, stop = t, end
                end += 1
            out.append(best)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals; n log n in the length of a long word."""
        ids, n = [self.byte_id[c] for c in word], len(word)
        if n <= SHORT:
            coded, none = self.coded, 1 << 60
            ranked = [coded.get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while ranked and (low := min(ranked)) < none:
                i = ranked.index(low)
                ids[i : i + 2] = [low & 0xFFFFF]
                del ranked[i]
                if i:
                    ranked[i - 1] = coded.get(ids[i - 1] << 20 | ids[i], none)
                if i < len(ranked):
                    ranked[i] = coded.get(ids[i] << 20 | ids[i + 1], none)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(r, i, t, x, y) for r, t, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, t, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = t, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], ids[p], ids[q]))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens."""
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (a >= 0) & (b >= 0), self.key_rank[place], _NEVER)

    def merge_together(self, words: Sequence[bytes]) -> list[list[int]]:
        """Exact merging of words of similar lengths: in each step every word has its leftmost merge of the lowest rank made."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        ids = np.full((len(words), width + 2), -1, np.int64)  # with nothing (-1) before and behind each word
        ids[:, 1:-1][np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(ids.shape, _NEVER)  # of a token and the one after it
        rank[:, 1:-1] = self.rank_of(ids[:, 1:-1], ids[:, 2:])
        after, before = np.tile(np.arange(1, width + 3), (len(words), 1)), np.tile(np.arange(-1, width + 1), (len(words), 1))
        row = np.arange(len(words))
        while len(row):
            at = rank[row].argmin(1)
            low = rank[row, at]
            go = low < _NEVER
            row, at, low = row[go], at[go], low[go]
            gone, ahead = after[row, at], before[row, at]
            behind = after[row, gone]
            made = self.made[low]
            ids[row, at], ids[row, gone], rank[row, gone], after[row, at], before[row, behind] = made, -1, _NEVER, behind, at
            rank[row, at], rank[row, ahead] = self.rank_of(made, ids[row, behind]), self.rank_of(ids[row, ahead], made)
        left = ids >= 0
        flat, ends = ids[left].tolist(), np.cumsum(left.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        """The encoding of each word."""
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for x in out for t in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failed = sorted(np.unique(owner[inside[~good[which]]]).tolist(), key=lambda k: len(words[k]))
        short = bisect.bisect_right(failed, SHORT, key=lambda k: len(words[k]))
        for at in range(0, short, TOGETHER):
            some = failed[at : min(at + TOGETHER, short)]
            for k, x in zip(some, self.merge_together([words[k] for k in some]), strict=True):
                out[k] = x
        for k in failed[short:]:
            out[k] = self.merge(words[k])
        return out

    def decode(self, tokens: Iterable[int]) -> str:
        """The text of tokens, special ones included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.texts.__getitem__, tokens)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts and remembers the pieces it has seen.

    A blank between two characters that aren't white space always starts a new word, so texts are cut there and the pieces, which
    repeat, are looked up; the pattern only runs over new pieces.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = regex.compile(WORD_PATTERN)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.known: dict[str, bytes] = {}  # piece -> its tokens as 32-bit integers, with the blank before it
        self.older: dict[str, bytes] = {}  # the generation before; what is used again moves on
        self.words: dict[str, bytes] = {}  # the same for words, which several pieces share
        self.older_words: dict[str, bytes] = {}

    def _learn(self, pieces: Sequence[str], lead: str = " ") -> dict[str, bytes]:
        found = [self.word.findall(lead + p) for p in pieces]
        if len(self.words) > MEMORY:
            self.words, self.older_words = {}, self.words
        new = {w for x in found for w in x}.difference(self.words)
        self.words |= {w: x for w in new if (x := self.older_words.get(w)) is not None}
        new = list(new.difference(self.words))
        self.words |= zip(new, (np.array(t, "<i4").tobytes() for t in self.v.encode_words([w.encode() for w in new])), strict=True)
        tokens = self.words
        return {p: b"".join([tokens[w] for w in x]) for p, x in zip(pieces, found, strict=True)}

    def _block(self, texts: Sequence[str]) -> list[bytes]:
        cut = []
        for t in texts:
            pieces = t.split(" ")
            if not all(pieces) or any(p[0].isspace() or p[-1].isspace() for p in set(pieces).difference(self.known)):
                pieces = self.cut.split(t)
            cut.append(pieces)
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = {p for pieces in cut for p in pieces[1:]}.difference(self.known)
        again = {p: x for p in new if (x := self.older.get(p)) is not None}
        self.known |= again | self._learn(list(new.difference(again)))
        first = self._learn(list({pieces[0] for pieces in cut}), "")
        known = self.known
        return [b"".join([first[pieces[0]], *[known[p] for p in pieces[1:]]]) for pieces in cut]

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        out, block, size = [], [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size > BLOCK_CHARS:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Token ids of each text; none for null. Special tokens in a text are recognised as such."""
        parts, shape = [], []
        for t in texts:
            t = t or ""
            marks = self.specials.findall(t) if self.specials and any(s in t for s in self.v.special) else []
            parts += self.specials.split(t) if marks else [t]
            shape.append(marks)
        coded, out = iter(self._plain(parts)), []
        for marks in shape:
            x = next(coded)
            for s in marks:
                x += np.array([self.v.special[s]], "<i4").tobytes() + next(coded)
            out.append(np.frombuffer(x, "<i4"))
        return out


def _shared(spark: SparkSession, path: str) -> Shared:
    """The vocabulary file's content, read once by the driver; its size doesn't depend on the corpus."""
    with open(path, encoding="utf-8") as f:
        return Shared(spark, f.read())


def encode_decode(docs: DataFrame, path: str, text: str = "text", result: str | None = None, keep: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """docs with a struct column (tokens array<int>, decoded string), and that column's name.

    Tokens are those that the tokenizers library gives for the file at ``path`` with add_special_tokens=False. Null and empty texts
    have no tokens and decode to an empty text. One row comes out for each row that goes in; nothing is shuffled.
    """
    shared, name = _shared(docs.sparkSession, path), free_name(docs.columns, result or "bpe")

    def build():
        encoder = shared.build(lambda content: Encoder(Vocabulary(content)))
        decode = encoder.v.decode

        def run(raw: pa.Array) -> pa.Array:
            tokens = encoder.encode(raw.cast(pa.large_string() if pa.types.is_large_binary(raw.type) else pa.string()).to_pylist())
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*tokens, np.empty(0, "<i4")]).astype(np.int32)))
            return pa.StructArray.from_arrays([ids, pa.array([decode(t.tolist()) for t in tokens], pa.string())], ["tokens", "decoded"])

        return run

    return annotate(docs, text, T.StructField(name, ENCODED), build, keep), name
