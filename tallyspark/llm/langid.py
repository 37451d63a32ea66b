"""Language identification with segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public byte-level
vocabulary.  The probability of a word (a run of letters and their combining marks, lower-cased, after a
space) is the sum over all its segmentations into pieces, found by a forward
algorithm; a text is the product over its words.  The most probable language wins,
weighed by its share of the labelled documents.

The piece probabilities are learned by expectation maximisation: forward and
backward sums give the expected use of every piece in each language's words.
Learning reads the whole texts of at most ``SAMPLE_DOCS`` labelled documents a
language, those with the smallest hash of their id; shares are counted over all
labelled documents.  A model holds languages x vocabulary numbers, whatever the
size of the corpus.

Words of one byte length are scored side by side in numpy.  Each task remembers
the scores of words it has met, up to ``MEMO`` of them; that never changes a result.

Defined results: a null text or one without a letter is ``und`` with score 0, and
so is every text if no document is labelled; ties go to the first language name;
repeated rows come back repeated; empty tables give empty results; the predictor
is a column, so other columns are never touched.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import small_batches, store

UNKNOWN = "und"
SAMPLE_DOCS = 2000
EM_STEPS = 3
EM_WORDS = 20_000  # words whose expected pieces are summed at once
SMOOTHING = 0.1
MAX_PIECE = 16  # bytes
MEMO = 1_000_000
HASH_BITS = 16
BLOCK_WORDS = 1_000_000  # words whose distinct ones are looked up together
GROUP = 4096  # words scored at once
LONG_WORD = 64  # bytes; longer words are scored a few at a time


ASCII_WORD, WORD = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")


def _of_kinds(*kinds: str) -> list[int]:
    """All code points of Unicode categories that begin with one of ``kinds``."""
    return [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(kinds)]


@lru_cache(maxsize=1)
def marks_and_numbers() -> frozenset[str]:
    """Characters that ``WORD`` takes for what they are not: marks (not part of words), numbers that are no digits (letters)."""
    return frozenset(map(chr, _of_kinds("M", "No", "Nl")))


@lru_cache(maxsize=1)
def marked_word() -> re.Pattern:
    """Runs of letters and the marks that belong to them."""

    def listed(*kinds: str) -> str:
        found = _of_kinds(*kinds)
        ends = [a for a, b in zip(found, [*found[1:], -1]) if b != a + 1]
        begins = [b for a, b in zip([-2, *found], found) if b != a + 1]
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(begins, ends))

    return re.compile(f"[{listed('L')}][{listed('L', 'M')}]*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each with the marks that follow its letters."""
    low = (text or "").lower()
    if low.isascii():
        return ASCII_WORD.findall(low)
    return (WORD if marks_and_numbers().isdisjoint(low) else marked_word()).findall(low)


class Pieces:
    """A numbered vocabulary, looked up by a 64-bit hash of a piece's bytes in an open-addressing table."""

    BITS = 18
    STEP = np.uint64(0x9E3779B97F4A7C15)
    SPREAD = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.none = pieces, len(pieces)
        self.keys = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.ids = np.full(1 << self.BITS, self.none, dtype=np.int64)
        for number, piece in enumerate(pieces):
            h = self.start(1)
            for byte in piece:
                h = self.add(h, np.array([byte], dtype=np.uint64))
            at = int(self.place(h)[0])
            while self.keys[at]:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ids[at] = h[0], number

    def __len__(self) -> int:
        return self.none

    @staticmethod
    def start(count: int) -> np.ndarray:
        return np.ones(count, dtype=np.uint64)

    def add(self, h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * self.STEP + byte + np.uint64(1)
        return h | np.uint64(1 << 63)  # never 0, the mark of an empty place

    def place(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, ``none`` where it is no piece's."""
        at = self.place(h)
        out, open_ = np.full(len(h), self.none, dtype=np.int64), np.arange(len(h))
        while len(open_):
            key = self.keys[at]
            hit = key == h[open_]
            out[open_[hit]] = self.ids[at[hit]]
            go_on = ~hit & (key != 0)
            open_, at = open_[go_on], (at[go_on] + 1) % len(self.keys)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    """Pieces of at most ``MAX_PIECE`` bytes; all single bytes are among them, so every word has a segmentation."""
    return Pieces(sorted(t for t in read_ranks(path) if len(t) <= MAX_PIECE))


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(parts)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def _lattice(words: list[bytes], pieces: Pieces) -> dict[tuple[int, int], np.ndarray]:
    """Piece number at every (begin, end) of equally long words; the vocabulary's size where there is none."""
    n, out = len(words[0]), {}
    text = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), n).T.astype(np.uint64)
    for i in range(n):
        h = pieces.start(len(words))
        for j in range(i + 1, min(n, i + MAX_PIECE) + 1):
            h = pieces.add(h, text[j - 1])
            ids = pieces.find(h)
            if j == i + 1 or (ids != pieces.none).any():
                out[i, j] = ids
    return out


def _forward(lattice, n: int, log_p: np.ndarray) -> list[np.ndarray]:
    """Log sums over segmentations of the first j bytes; log_p has a last row of -inf."""
    words = len(lattice[0, 1])
    alpha = [np.zeros((words, log_p.shape[1]))]
    for j in range(1, n + 1):
        alpha.append(_log_sum([alpha[i] + log_p[lattice[i, j]] for i in range(max(0, j - MAX_PIECE), j) if (i, j) in lattice]))
    return alpha


def _backward(lattice, n: int, log_p: np.ndarray) -> list[np.ndarray]:
    words = len(lattice[0, 1])
    beta = [np.zeros((words, log_p.shape[1])) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        ends = range(i + 1, min(n, i + MAX_PIECE) + 1)
        beta[i] = _log_sum([beta[j] + log_p[lattice[i, j]] for j in ends if (i, j) in lattice])
    return beta


def _by_length(words: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Positions and bytes of words, in groups of one byte length."""
    groups = defaultdict(list)
    raw = [b" " + w.encode("utf-8", "replace") for w in words]
    for at, w in enumerate(raw):
        groups[len(w)].append(at)
    for size, members in groups.items():
        step = GROUP if size <= LONG_WORD else 16
        for at in range(0, len(members), step):
            yield members[at : at + step], [raw[m] for m in members[at : at + step]]


def _padded(log_p: np.ndarray) -> np.ndarray:
    """A row for "no such piece": small enough to vanish in every sum, finite so that differences stay defined."""
    return np.vstack([log_p, np.full((1, log_p.shape[1]), -1e30)])


def score_words(words: list[str], log_p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log probability of each word in each language (a column of ``log_p``)."""
    out, padded = np.empty((len(words), log_p.shape[1])), _padded(log_p)
    for members, raw in _by_length(words):
        lattice = _lattice(raw, pieces)
        out[members] = _forward(lattice, len(raw[0]), padded)[-1]
    return out


def expected_pieces(words: list[str], counts: np.ndarray, log_p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected number of uses of every piece in ``counts`` copies of each word, for one language."""
    padded = _padded(log_p.reshape(-1, 1))
    used, shares = [], []
    for members, raw in _by_length(words):
        lattice, n = _lattice(raw, pieces), len(raw[0])
        alpha, beta = _forward(lattice, n, padded), _backward(lattice, n, padded)
        for (i, j), ids in lattice.items():
            used.append(ids)
            shares.append(np.exp(alpha[i] + padded[ids] + beta[j] - alpha[n])[:, 0] * counts[members])
    if not used:
        return np.zeros(len(pieces))
    return np.bincount(np.concatenate(used), weights=np.concatenate(shares), minlength=len(pieces) + 1)[:-1]


class Model:
    """Log probabilities of pieces (rows) in languages (columns) and the languages' log shares."""

    def __init__(self, languages: list[str], log_share: np.ndarray, log_p: np.ndarray, path: str):
        self.languages, self.log_share, self.log_p, self.path = languages, log_share, log_p, path
        self.forget()

    def __getstate__(self):
        return self.languages, self.log_share, self.log_p, self.path

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.languages)))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of ``scores`` that hold the words' scores, until the next call."""
        if len(self.number) > MEMO:
            self.forget()
        fresh = [w for w in words if w not in self.number]
        begin, end = len(self.number), len(self.number) + len(fresh)
        if end > len(self.scores):
            grown = np.empty((max(end, 2 * len(self.scores)), len(self.languages)))
            grown[:begin] = self.scores[:begin]
            self.scores = grown
        if fresh:
            self.scores[begin:end] = score_words(fresh, self.log_p, vocabulary(self.path))
            self.number.update(zip(fresh, range(begin, end)))
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability for each text; each distinct word of a block is looked up once."""
        out: list[tuple[str, float]] = []
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(words_of(text))
            size += len(block[-1])
            if size >= BLOCK_WORDS:
                out += self._predict(block)
                block, size = [], 0
        return out + self._predict(block)

    def _predict(self, block: list[list[str]]) -> list[tuple[str, float]]:
        sizes = np.fromiter(map(len, block), dtype=np.int64, count=len(block))
        if not self.languages or not sizes.sum():
            return [(UNKNOWN, 0.0)] * len(block)
        numbered = pc.dictionary_encode(pa.array(list(chain.from_iterable(block)), pa.large_string()))
        rows = self._numbers(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
        some = np.flatnonzero(sizes)
        begins = (np.cumsum(sizes) - sizes)[some]
        total = np.add.reduceat(self.scores[rows], begins, axis=0) + self.log_share
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total[np.arange(len(some)), best][:, None]).sum(axis=1)
        out = [(UNKNOWN, 0.0)] * len(block)
        for i, b, p in zip(some.tolist(), best.tolist(), share.tolist()):
            out[i] = (self.languages[b], round(p, 6))
        return out


def least_hashed(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of (id, lang) of each language with the smallest hash of their id.

    Rows are counted by the hash's first bits; only those with first bits that can be among the smallest are ranked.
    """
    ids = ids.withColumn("hash", F.xxhash64("id")).withColumn("high", F.shiftright("hash", 64 - HASH_BITS))
    sizes = ids.groupBy("lang", "high").agg(F.count(F.lit(1)).alias("n"))  # 2**HASH_BITS rows a language at most
    before = Window.partitionBy("lang").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    near = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < most)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    few = ids.join(near.select("lang", "high"), ["lang", "high"]).withColumn("nth", nth)
    return few.where(F.col("nth") <= most).select("id", "lang")


def learn(
    labelled: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, steps: int = EM_STEPS,
) -> Model:
    """Fit a model on labelled documents (rows with a null language or id are left out)."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and lang is not null")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(shares)
    pieces = vocabulary(path)
    if not languages:
        return Model([], np.zeros(0), np.zeros((len(pieces), 0)), path)
    chosen = store(least_hashed(rows.select("id", "lang"), sample_docs), "langid")
    sample = rows.join(chosen, ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"]):
                n[lang].update(words_of(text))
            found = [(lang, w, c) for lang, ws in n.items() for w, c in ws.items()]
            yield pd.DataFrame(found, columns=["lang", "word", "n"])

    words = sample.mapInPandas(count, "lang string, word string, n long")
    words = store(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid")
    log_p = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            own = vocabulary(path)

            def add(rows: pd.DataFrame) -> None:
                for lang, group in rows.groupby("lang"):
                    column = shared.value[:, languages.index(lang)]
                    used = expected_pieces(list(group["word"]), group["n"].to_numpy(float), column, own)
                    total[lang] = total.get(lang, 0) + used

            held: list[pd.DataFrame] = []
            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= EM_WORDS:
                    add(pd.concat(held))
                    held = []
            if held:
                add(pd.concat(held))
            for lang, used in total.items():
                at = np.flatnonzero(used > 0)
                yield pd.DataFrame({"lang": lang, "piece": at, "n": used[at]})

        used = words.mapInPandas(expect, "lang string, piece long, n double")
        used = used.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # languages x vocabulary at most
        expected = np.full(log_p.shape, SMOOTHING)
        np.add.at(expected, (used["piece"].to_numpy(), used["lang"].map(languages.index).to_numpy(np.int64)), used["n"].to_numpy())
        log_p = np.log(expected / expected.sum(axis=0))
    share = np.array([shares[x] for x in languages], dtype=float)
    return Model(languages, np.log(share / share.sum()), log_p, path)


def predict(text: Column | str, model: Model, spark) -> Column:
    """struct(lang, score) of each text."""
    shared = spark.sparkContext.broadcast(model)

    small_batches()

    @F.pandas_udf("lang string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(list(texts)), columns=["lang", "score"])

    return best(text)
