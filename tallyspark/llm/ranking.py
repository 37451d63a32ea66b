"""Quality scores by Bradley-Terry pairwise ranking.

A document is a vector of statistics of its whole text (shares of character classes, of
repeated words, word runs and lines, word lengths ...).  Documents of label 1 are preferred
to those of label 0: the chance that i is preferred to j is the logistic function of
s(i) - s(j), with s linear in the statistics, and the loss is logistic on the feature
differences of all pairs of one labelled document of each label.

The threshold is a quantile of the labelled documents' scores: the share of label 0 among
them, so that as many of them fall below it as have label 0.  A score is the logistic
function of the distance to the threshold, shifted so that the threshold itself scores
``cutoff``.

Every labelled document counts: in the mean and scale of the statistics, in the weights and in the threshold.
The pairs are never formed: a logistic function of s(i) - s(j) is, to rounding, a short sum of
products of Chebyshev polynomials of s(i) and of s(j), so the sums over all pairs come from the sums of each
label's polynomials times its statistics (``moments``), one pass over the documents a Newton step.  The threshold is found by
counting scores in ever narrower bins.  The driver gets sums and counts, at most ``FEW`` distinct scores at the end.

Defined results: a null or empty text has all statistics 0 and a score like any other;
labels other than 0 and 1 and null ids are not learned from; without a document of each
label every score is the share of label 1 (0.5 without any); repeated rows come
back repeated, and are learned from once; a document with both labels counts for both; an
empty table gives an empty result; the score is a column, so other columns are never touched.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

RIDGE = 0.02
STEPS = 40
CLIP = 6.0
CUTOFF = 0.7
RUN = 3  # words
BINS = 4096
FEW = 10_000  # scores that the driver looks at one by one
FAN = 16  # tasks that add up what the others found

LETTER = np.zeros(256, dtype=bool)
LETTER[[ord(c) for c in string.ascii_letters]] = True
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", string.digits, "!?", ".,;:'\"()-", "#$%&*+/<=>@[\\]^_`{|}~", " \t\n\r\v\f")
NAMES = (
    "upper", "digit", "exclaiming", "pointing", "symbol", "space", "above_ascii", "entropy", "log_words", "word_length",
    "long_words", "distinct", "herdan", "most_frequent", "adjacent_equal", "repeated_runs", "repeated_lines", "log_line_words",
    "bare_marks", "marked_ends", "upper_words",
)
MARKS = frozenset(b"!#$%&*+/<=>@[\\]^_`{|}~?")


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, all in a range of a few units."""
    raw = (text or "").encode("utf-8", "replace")
    tokens = raw.split()
    if not tokens:
        return [0.0] * len(NAMES)
    byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = byte / len(raw)
    some = share[share > 0]
    n, counts = len(tokens), Counter(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    hashes = np.fromiter(map(hash, tokens), np.int64, n)
    adjacent = np.count_nonzero(hashes[1:] == hashes[:-1]) / n
    repeated = 0.0
    if n > RUN:
        with np.errstate(over="ignore"):
            runs = sum(hashes[i : n - RUN + 1 + i] * np.int64(2 * 1_000_003**i + 1) for i in range(RUN))
        repeated = 1 - len(np.unique(runs)) / len(runs)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(byte[LETTER].sum()))
    classes = [float(share[[ord(c) for c in chars]].sum()) for chars in CLASSES]
    classes[0] = float(byte[65:91].sum()) / letters
    return [
        *classes,
        float(share[128:].sum()),
        float(-(some * np.log2(some)).sum()) / 8,
        math.log1p(n) / 10,
        min(float(lengths.mean()), 100.0) / 10,
        float((lengths > 20).mean()),
        len(counts) / n,
        math.log1p(len(counts)) / math.log1p(n),
        max(counts.values()) / n,
        adjacent,
        float(repeated),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)) / 10,
        sum(c for w, c in counts.items() if not any(b >= 128 or 48 <= b <= 57 or LETTER[b] for b in w)) / n,
        sum(c for w, c in counts.items() if w[-1] in MARKS) / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
    ]


class Model:
    """Standardised weights, the threshold and the score it has."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, cutoff: float, flat: float | None):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.threshold, self.cutoff, self.flat = threshold, cutoff, flat

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.norm(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        shift = math.log(self.cutoff / (1 - self.cutoff))
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + shift, -500, 500)))


def newton(derivatives: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """The weights at which the slope of a loss and of ``ridge`` is zero, from its slope and second derivatives."""
    w = np.zeros(size)
    for _ in range(steps):
        slope, curve = derivatives(w)
        step = np.linalg.solve(curve + ridge * np.eye(size), slope + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic_terms(reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev coefficients, by k and l, of 1 / (1 + exp(s - t)) and of its slope, for s and t in [-reach, reach]."""
    grow = math.pi / reach + math.hypot(1, math.pi / reach)  # the nearest poles are pi away
    n = math.ceil(38 / math.log(grow)) + 8
    nodes = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    lost = 1 / (1 + np.exp(np.clip(reach * (nodes[:, None] - nodes[None, :]), -500, 500)))
    to_terms = 2 / n * np.cos(np.pi * np.outer(np.arange(n), np.arange(n) + 0.5) / n)
    to_terms[0] /= 2
    return to_terms @ lost @ to_terms.T, to_terms @ (lost * (1 - lost)) @ to_terms.T


def moments(x: np.ndarray, scores: np.ndarray, terms: int) -> np.ndarray:
    """Sums over the rows, by term k: the Chebyshev polynomial k of the score times 1, x and the products of x."""
    n, size = x.shape
    out = np.zeros((terms, 1 + size + size * size))
    for at in range(0, n, 4096):
        part = x[at : at + 4096]
        products = (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
        polynomials = np.cos(np.arange(terms)[:, None] * np.arccos(np.clip(scores[at : at + 4096], -1, 1))[None, :])
        out += polynomials @ np.hstack([np.ones((len(part), 1)), part, products])
    return out


def pair_derivatives(better: np.ndarray, worse: np.ndarray, lost: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and second derivatives of the mean logistic loss of all pairs' feature differences, from both labels' moments."""
    size = math.isqrt(better.shape[1])
    (n, x, xx), (m, y, yy) = ((a[:, 0], a[:, 1 : 1 + size], a[:, 1 + size :].reshape(-1, size, size)) for a in (better, worse))
    pairs = n[0] * m[0]
    slope = n @ lost @ y - m @ lost.T @ x
    cross = x.T @ bend @ y
    curve = np.tensordot(bend @ m, xx, 1) + np.tensordot(n @ bend, yy, 1) - cross - cross.T
    return slope / pairs, curve / pairs


def fit_weights(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Bradley-Terry weights: Newton steps on the mean logistic loss of all pairs' feature differences."""

    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = [better @ w, worse @ w]
        middle, reach = _reach(min(s.min() for s in scores), max(s.max() for s in scores))
        lost, bend = logistic_terms(reach)
        both = [moments(x, (s - middle) / reach, len(lost)) for x, s in zip((better, worse), scores)]
        return pair_derivatives(*both, lost, bend)

    return newton(derivatives, better.shape[1], ridge, steps)


def _reach(least: float, most: float) -> tuple[float, float]:
    return (least + most) / 2, max((most - least) / 2 * (1 + 1e-9), 0.1)


def quantile(scores: np.ndarray, weights: np.ndarray, level: float) -> float:
    """Midway between the last score up to which the weights reach ``level`` of their sum, and the next."""
    order = np.argsort(scores, kind="stable")
    reached = np.cumsum(weights[order]) / weights.sum()
    at = min(int(np.searchsorted(reached, level - 1e-9)), len(order) - 1)
    return float(scores[order[at]] + scores[order[min(at + 1, len(order) - 1)]]) / 2


def fit(better: np.ndarray, worse: np.ndarray, n_better: int, n_worse: int, cutoff: float = CUTOFF) -> Model:
    """A model from the statistics of documents of both labels in memory; their labels weigh as ``n_better`` and ``n_worse`` documents."""
    if not len(better) or not len(worse):
        return flat_model(n_better, n_worse, cutoff)
    both = np.vstack([better, worse])
    model = scaled_model(both.mean(axis=0), both.std(axis=0), cutoff)
    model.weights = fit_weights(model.norm(better), model.norm(worse))
    weights = np.repeat([n_better / len(better), n_worse / len(worse)], [len(better), len(worse)])
    model.threshold = quantile(model.raw(both), weights, n_worse / (n_better + n_worse))
    return model


def flat_model(n_better: int, n_worse: int, cutoff: float) -> Model:
    blank, total = np.zeros(len(NAMES)), n_better + n_worse
    return Model(blank, blank + 1, blank, 0.0, cutoff, n_better / total if total else 0.5)


def scaled_model(mean: np.ndarray, scale: np.ndarray, cutoff: float) -> Model:
    return Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(len(mean)), 0.0, cutoff, None)


def total(rows: DataFrame, found: Callable[[np.ndarray, np.ndarray], np.ndarray], add: Callable = np.add) -> np.ndarray:
    """``found(labels, statistics)`` of all batches of ``rows``, added up by the tasks, and by ``FAN`` of them for all."""

    def merged(arrays: Iterator[np.ndarray]) -> list[bytes]:
        out = None
        for a in arrays:
            out = a if out is None else add(out, a)
        return [] if out is None else [np.asarray(out, dtype=float).tobytes()]

    def batch_arrays(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return found(batch.column(0).to_numpy(zero_copy_only=False), x)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = merged(batch_arrays(b) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sums"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = merged(np.frombuffer(v) for b in batches for v in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sums"])

    some = rows.select("label", "x").mapInArrow(parts, "sums binary").repartition(FAN).mapInArrow(sums, "sums binary")
    return np.frombuffer(merged(np.frombuffer(r.sums) for r in some.collect())[0])


def fit_table(rows: DataFrame, n_better: int, n_worse: int, cutoff: float = CUTOFF) -> Model:
    """``fit`` on a table of (label, statistics x), each step a pass over it."""
    size = len(NAMES)
    first = total(rows, lambda label, x: np.concatenate([[(label == 1).sum(), (label == 0).sum()], x.sum(axis=0)]))
    found = first[:2]
    mean = first[2:] / found.sum()
    spread = total(rows, lambda label, x: ((x - mean) ** 2).sum(axis=0))
    model = scaled_model(mean, np.sqrt(spread / found.sum()), cutoff)

    def ends(w: np.ndarray) -> tuple[float, float]:
        low, high = total(rows, lambda label, x: np.array([-(s := model.norm(x) @ w).min(), s.max()]), np.maximum)
        return -low, high

    def derivatives(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, reach = _reach(*ends(w))
        lost, bend = logistic_terms(reach)

        def both(label: np.ndarray, x: np.ndarray) -> np.ndarray:
            x = model.norm(x)
            at = (x @ w - middle) / reach
            return np.concatenate([moments(x[label == k], at[label == k], len(lost)).ravel() for k in (1, 0)])

        return pair_derivatives(*total(rows, both).reshape(2, len(lost), -1), lost, bend)

    model.weights = newton(derivatives, size)
    weights = np.array([n_better, n_worse]) / found
    model.threshold = _table_quantile(rows, model, weights, n_worse, *ends(model.weights))
    return model


def _table_quantile(rows: DataFrame, model: Model, weights: np.ndarray, reach: float, low: float, high: float) -> float:
    """``quantile`` of the scores of a table's rows, whose labels 1 and 0 have the ``weights``, at the weight ``reach``."""
    target = reach * (1 - 1e-9)
    below, high = 0.0, np.nextafter(high, np.inf)  # scores from low on, under high
    while True:
        edges = np.unique(np.append(np.linspace(low, high, BINS + 1)[:-1], high))

        def binned(label: np.ndarray, x: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
            s = model.raw(x)
            inside = (s >= edges[0]) & (s < edges[-1])
            at = np.searchsorted(edges, s[inside], side="right") - 1
            return np.concatenate([np.bincount(at[label[inside] == k], minlength=len(edges) - 1) for k in (1, 0)])

        counts = total(rows, binned).reshape(2, -1)
        reached = below + np.cumsum(weights @ counts)
        at = min(int(np.searchsorted(reached, target)), int(np.flatnonzero(counts.sum(axis=0))[-1]))
        below = float(reached[at] - weights @ counts[:, at])
        low, high = float(edges[at]), float(edges[at + 1])
        if counts[:, at].sum() <= FEW or high <= np.nextafter(low, np.inf):
            break

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = model.raw(x)
            here = (s >= low) & (s < high)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False)[here]), pa.array(s[here])], ["label", "score"])

    few = rows.select("label", "x").mapInArrow(inside, "label int, score double").groupBy("score")
    few = few.agg(F.sum("label").alias("better"), F.sum(1 - F.col("label")).alias("worse")).orderBy("score").collect()
    above = total(rows, lambda label, x: np.array([np.min(s[s >= high], initial=np.inf) if len(s := model.raw(x)) else np.inf]), np.minimum)[0]
    for r, after in zip(few, [*few[1:], None]):
        below += float(weights @ [r.better, r.worse])
        if below >= target or after is None:
            # the last row of this score is the one that reaches the target, or a row before it
            last = below - weights[1 if r.worse else 0] < target or r.better + r.worse == 1
            following = after.score if after is not None else above if np.isfinite(above) else r.score
            return (r.score + (following if last else r.score)) / 2


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_docs: int | None = None, cutoff: float = CUTOFF, x_col: str | None = None,
) -> Model:
    """Fit on all labelled documents of ``docs``; if ``sample_docs`` is given, on so many of each label by the hash of their id.

    ``x_col``: the column of ``docs`` that holds ``described`` texts already, which then need not be joined with the labels.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where("id is not null and label in (0, 1)").distinct()
    n = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sample_docs is not None:
        order = [F.xxhash64("id"), "id"]
        marks = [marks.where(F.col("label") == x).orderBy(*order).limit(sample_docs) for x in (0, 1)]
        marks = marks[0].unionByName(marks[1])
    marks = store(marks, "ranking")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(x_col or text_col).alias("given")).join(marks, "id")
    x = F.col("given") if x_col else described("given")
    rows = store(rows.select("id", "label", x.alias("x")).distinct(), "ranking")
    if rows.select("label").distinct().count() < 2:
        return flat_model(n.get(1, 0), n.get(0, 0), cutoff)
    return fit_table(rows, n.get(1, 0), n.get(0, 0), cutoff)


def described(text: Column | str) -> Column:
    """The statistics of each text."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    return vectors(text)


def score(text: Column | str, model: Model, spark) -> Column:
    """The score of each text, from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch], dtype=float).reshape(-1, len(NAMES))
            yield pd.Series(shared.value.score(x), dtype=float)

    return scores(text)


def score_described(x: Column | str, model: Model, spark) -> Column:
    """``score`` of texts that are described already."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array(batch.tolist(), dtype=float).reshape(-1, len(NAMES))
            yield pd.Series(shared.value.score(x), dtype=float)

    return scores(x)
