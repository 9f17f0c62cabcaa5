"""Operator 4: quality classifier, a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and fits a shallow tree to the current residuals
on that feature's bins alone; what the trees say is summed into a lookup table a feature. The pairs
whose joint residuals fall furthest get two-dimensional tables the same way. A document's score is a
sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.runtime import ship

#: The model is fitted on at most so many labelled documents, those with the least hashed ids.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 12, 6, 150, 0.15
#: Share of good held-out documents that may score below the threshold.
CLEAN_LOSS = 0.001

FEATURES = (
    "log_chars", "word_chars", "distinct_words", "top_word", "repeated_next", "upper", "digits", "punctuation",
    "bars", "symbols", "exclamations", "line_words", "distinct_lines", "symbol_ends", "spaces", "sentence_ends",
    "long_words", "alphabet",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\=+_", np.uint8)
_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_ENDS = re.compile(r"[#$%&*@^~<>{}\\=+_|!](?=\s|$)")


def features(text: str | None) -> np.ndarray:
    """Feature vector of one whole text; a null or blank text gives zeros."""
    out = np.zeros(len(FEATURES))
    words = text.split() if text else []
    if not words:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    n, w = len(raw), len(words)
    counts = Counter(words)
    lines = text.split("\n")
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    out[:] = (
        np.log1p(n),
        sum(map(len, words)) / w,
        len(counts) / w,
        max(counts.values()) / w,
        sum(map(operator.eq, words, words[1:])) / w,
        upper / max(upper + lower, 1),
        hist[48:58].sum() / n,
        hist[_PUNCTUATION].sum() / n,
        hist[124] / w,
        hist[_SYMBOLS].sum() / n,
        hist[33] / w,
        w / len(lines),
        len(set(lines)) / len(lines),
        len(_ENDS.findall(text)) / w,
        (hist[32] + hist[10] + hist[9]) / n,
        hist[46] / w,
        sum(len(x) > 20 for x in counts) / len(counts),
        np.count_nonzero(hist) / 64,
    )
    return out


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


@dataclass
class Additive:
    """Edges and lookup tables; ``threshold`` is on the logit."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    threshold: float = -np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, edges in enumerate(self.edges):
            out += self.tables[j][np.searchsorted(edges, x[:, j], side="right")]
        if self.pairs:
            at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                out += table[at[a], at[b]]
        return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a greedy tree over ordered bins, as one value a bin."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))

    def worth(lo, hi):
        return (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + 1.0)

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                cut = np.arange(lo + 1, hi)
                gain = worth(lo, cut) + worth(cut, hi) - worth(lo, hi)
                gain = np.where((h[cut] - h[lo] > 0.5) & (h[hi] - h[cut] > 0.5), gain, 0.0)
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), k, int(cut[i])), key=lambda t: t[0])
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + 1.0)
    return out


def _quarters(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Best single cut of either side of a pair's grid: the gain, and the step in each cell."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gg, hh = g[-1, -1], h[-1, -1]
    a, b = g[1:-1, 1:-1], h[1:-1, 1:-1]
    if not a.size:
        return 0.0, np.zeros_like(grad)
    gs = (a, g[1:-1, -1:] - a, g[-1:, 1:-1] - a, gg - g[1:-1, -1:] - g[-1:, 1:-1] + a)
    hs = (b, h[1:-1, -1:] - b, h[-1:, 1:-1] - b, hh - h[1:-1, -1:] - h[-1:, 1:-1] + b)
    gain = sum(x * x / (y + 1.0) for x, y in zip(gs, hs)) - gg * gg / (hh + 1.0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(grad)
    for (rows, cols), x, y in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs):
        step[rows, cols] = x[i, j] / (y[i, j] + 1.0)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Additive:
    """Fit on every row; the threshold comes from a fifth of the rows that a first fit doesn't see.

    With labels of one class only, or none, nothing can be learned: every document scores alike and
    is kept.
    """
    if len(x) < 20 or y.min() == y.max():
        none = [np.zeros(0)] * len(FEATURES)
        return Additive(none, none, 0.0, np.zeros((len(FEATURES), 1)))
    held = np.arange(len(x)) % 5 == 4
    trial = _boost(x[~held], y[~held], rounds, pairs)
    good, bad = np.sort(trial.score(x[held & (y == 1)])), trial.score(x[held & (y == 0)])
    model = _boost(x, y, rounds, pairs)
    floor = good[int(CLEAN_LOSS * len(good))] if len(good) else 0.0
    # Halfway between the least good score that counts and the bad scores under it; never above even odds.
    below = bad[bad < floor]
    model.threshold = min(0.0, (floor + (below.max() if len(below) else floor - 2.0)) / 2)
    return model


def _boost(x: np.ndarray, y: np.ndarray, rounds: int, pairs: int) -> Additive:
    model = Additive([_edges(c, BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T])
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model.base = float(np.log(rate / (1 - rate)))
    width = max(len(e) for e in model.edges) + 1
    model.tables = np.zeros((x.shape[1], width))
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    z = np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, width), np.bincount(b, h, width))
            model.tables[j] += step
            z += step[b]
    low = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
    size = [len(e) + 1 for e in model.coarse]

    def grid(a, b, v):
        return np.bincount(low[a] * size[b] + low[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quarters(grid(*p, g), grid(*p, h))[0])
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quarters(grid(a, b, g), grid(a, b, h))[1]
            table += step
            z += step[low[a], low[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents; only features reach the driver.

    Rows of ``labels`` without an id or a label are left out; repeated ones count as their mean. An id with
    several documents counts once, with the least of its texts.
    """
    ship(docs.sparkSession)
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(matrix(texts)), dtype=object)

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` pairs of numbers
    once = joined.groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    found = once.select("doc_id", "good", vector("text").alias("x")).toPandas().sort_values(["doc_id", "good"], kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return x, found["good"].to_numpy(dtype=float)


def scorer(model: Additive) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = matrix(texts)
            out = model.score(x)
            out[x[:, 0] == 0] = -np.inf if np.isfinite(model.threshold) else 0.0
            yield pd.Series(out)

    return score


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, score, keep)`` for each row of ``docs``.

    ``score`` is the chance of good quality. Narrow: one pass, no shuffle. A null or blank text scores
    0 and isn't kept, unless there was nothing to learn from, when all are kept with a score of 0.5;
    an empty table gives no rows; repeated rows score alike; texts of any length are read whole; other
    columns aren't read.
    """
    model = fit(*training_rows(docs, labels, rows))
    score = scorer(model)(F.col("text"))
    return docs.select("doc_id", score.alias("_s")).select(
        "doc_id", (1 / (1 + F.exp(-F.col("_s")))).alias("score"), (F.col("_s") >= F.lit(float(model.threshold))).alias("keep")
    )


def kept(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns."""
    model = fit(*training_rows(docs, labels, rows))
    return docs.where(scorer(model)(F.col("text")) >= F.lit(float(model.threshold)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
