"""Operator 7: a quality classifier by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled documents train a small model g on text statistics by the non-negative
unbiased risk with squared losses: pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)). Squared losses need only sums of products
of the statistics, so the unlabelled part of the risk is taken over all documents in one pass, and the driver solves for
g with one small matrix. Labelled negatives are never used.

The class prior pi is estimated from positives and unlabelled documents alone. Without the non-negativity g ranks
documents alike whatever pi is; above any of its values lie at least pi times as large a share of all documents as of
the positives. The smallest such ratio, over values with many positives on both sides and on positives that g was not
fitted to, each raised by two standard errors, is the estimate. The score is 0.5 where g is 0, that is where a document is as likely good as not.

The fit takes at most ``sample`` labelled rows (the only bound); everything else covers every text whole. Nulls count as
empty texts, which have the statistics of a text without words. Without four positives or without documents every
score is 0.5. Rows that repeat an id are scored one by one; among the positives one of them counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, textops
from .common import bytes_of, materialize, slices
from .quality_rules import repeated_words

SIGNS = b"#*$%&|<>!?.,:;\"'()[]{}=+-_/\\@~^`"
NAMES = ["words", "word_length", "long_words", "upper", "digit", "high", "space", "lines", "line_words", "same_lines", "repeats", "distinct", "line_ends", *(f"sign_{c}" for c in SIGNS)]


def statistics(data: bytes) -> list[float]:
    """Statistics of one text in UTF-8, in the order of ``NAMES``."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    starts, ends, hashes = textops.word_hashes(data)
    n, size = len(starts), max(1, len(data))
    sizes = ends - starts
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    w = max(1, n)
    return [
        math.log1p(n), float(sizes.mean()) if n else 0.0, float((sizes > 20).mean()) if n else 0.0, counts[65:91].sum() / letters, counts[48:58].sum() / size,
        counts[128:].sum() / size, (size - int(sizes.sum())) / size, math.log1p(m), math.log1p(n / m), 1 - len(set(lines)) / m if lines else 0.0,
        repeated_words(hashes) / w, len(np.unique(hashes)) / w, sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / m,
        *(math.log1p(10 * counts[c] / w) for c in SIGNS),
    ]


#: Bins of the scores from which the prior is read, their least and greatest value; shares of positives below a bound.
BINS, LOW, HIGH, BELOW = 4000, -1.0, 3.0, (0.005, 0.5)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z / 4])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(4 * self.margin(x), -30, 30)))


def minimise(second: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, square: np.ndarray, prior: float, ridge: float, steps: int = 2000) -> np.ndarray:
    """Weights of least non-negative risk. ``second`` and ``square``: means of products over unlabelled rows and over
    positives; ``unlabelled`` and ``positive``: means. Where the negative part is below zero its ascent step is taken."""
    penalty = ridge * np.diag(np.r_[0.0, np.ones(len(second) - 1)])
    free = np.linalg.solve(second + penalty, 2 * prior * positive - unlabelled)

    def negative(w: np.ndarray) -> float:
        return (w @ second @ w + 2 * unlabelled @ w + 1 - prior * (w @ square @ w + 2 * positive @ w + 1)) / 4

    if negative(free) >= 0:
        return free
    w, best = free, (math.inf, free)
    rate = 1.0 / np.linalg.eigvalsh(second + prior * square + penalty)[-1]
    for _ in range(steps):
        n = negative(w)
        slope = (second @ w + unlabelled - prior * (square @ w + positive)) / 2
        fit = prior * (square @ w - positive) / 2
        risk = prior * (w @ square @ w - 2 * positive @ w + 1) / 4 + max(0.0, n) + w @ penalty @ w / 4
        best = min(best, (risk, w), key=lambda x: x[0])
        w = w - rate * (fit + slope + penalty @ w / 2 if n >= 0 else -slope)
    return best[1]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>): the statistics of each text."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            x = [statistics(d) for d in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"id {kind}, x array<double>")


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, len(NAMES))


def moments(table: DataFrame, model: Model) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows of a table of statistics, and means of the design and of its products, summed where the rows are."""
    size = 2 * len(NAMES) + 1
    upper = np.triu_indices(size)

    def work(batches):
        total = np.zeros(len(upper[0]))
        for batch in batches:
            f = model.design(matrix(batch))
            total += (f.T @ f)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    sums = np.zeros((size, size))
    for r in table.select("x").mapInArrow(work, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row an entry of the matrix
        sums[upper[0][r["k"]], upper[1][r["k"]]] = r["v"]
    sums = sums + sums.T - np.diag(np.diag(sums))
    n = int(round(sums[0, 0]))
    return n, sums[0] / max(1, n), sums / max(1, n)


def estimated_prior(table: DataFrame, model: Model, fresh: np.ndarray) -> float:
    """The smallest ratio of the shares of all documents and of ``fresh`` positives above a value of the margin."""

    def binned(m: np.ndarray) -> np.ndarray:
        return np.bincount(np.clip((m - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int), minlength=BINS)

    def work(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += binned(model.margin(matrix(batch)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["k", "n"])

    every = np.zeros(BINS)
    for r in table.select("x").mapInArrow(work, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row a bin
        every[r["k"]] = r["n"]
    good = binned(model.margin(fresh))
    above = lambda c: 1 - (np.cumsum(c) - c) / c.sum()
    all_above, good_above = above(every), above(good)
    use = (1 - good_above >= BELOW[0]) & (1 - good_above <= BELOW[1])
    if not use.any():
        return 0.5
    share = good_above[use]
    error = np.sqrt((1 - share) / (share * len(fresh)))  # so that accidents of few positives aren't the smallest
    return float(min(0.99, max(0.01, (all_above[use] / share * (1 + 2 * error)).min())))


def fit(table: DataFrame, documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text", ridge: float = 1e-2) -> Model | None:
    """A model from at most ``sample`` trusted positives and from ``table``, the statistics of all documents."""
    trusted = labelled.sample(documents, labels, "quality", folds, held_out, sample, id_col, text_col, classes=(1,))
    known = features(trusted, "id").orderBy("id").collect()
    x = np.array([r["x"] for r in known]).reshape(-1, len(NAMES))
    if len(x) < 4:
        return None
    scale = x.std(0)
    model = Model(x.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(1 + 2 * len(NAMES)), 0.5)
    n, first, second = moments(table, model)
    if n == 0:
        return None
    penalty = ridge * np.diag(np.r_[0.0, np.ones(len(first) - 1)])
    half = np.random.default_rng(7).permutation(len(x)) % 2 == 0
    model.weights = np.linalg.solve(second + penalty, model.design(x[half]).mean(0))
    model.prior = estimated_prior(table, model, x[~half])
    f = model.design(x)
    model.weights = minimise(second, first, f.mean(0), f.T @ f / len(f), model.prior, ridge)
    return model


def score(table: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """One row per row of a table of statistics: the id, ``score`` (higher: better) and ``predicted``."""
    kind = table.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            s = model.score(matrix(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    return table.select("id", "x").mapInArrow(work, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Statistics of all documents, written once; a model fitted to them; and its scores."""
    table = materialize(features(documents, id_col, text_col))
    return score(table, fit(table, documents, labels, id_col=id_col, text_col=text_col, **options), id_col)
