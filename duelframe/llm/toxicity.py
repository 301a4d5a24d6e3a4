"""Toxicity as ordinal grades: one score per text, and thresholds that grow.

The score is a weighted sum of hashed words; the chance of grade ``k`` or more is
the logistic function of the score less the k-th threshold, so that all grades
share the weights.

A null text has no words, and a text without words has the lowest grade. Rows with an equal
doc_id are scored one by one. Rows without a grade teach nothing; without any,
or with one grade alone, all texts have that grade (0 if there is none). An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

BUCKETS = 1 << 18
SAMPLE = 6000  # labelled texts that the fit may use
STEPS = 300
RATE = 0.1
SHRINK = 1e-4
LEAST_TEXTS = 3  # of the sample, that a bucket needs for a weight

_WORD = regex.compile(r"[\p{L}\p{N}']+")


class Features:
    """Sparse features of texts: logarithms of word counts, scaled to length one."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall((text or "").lower())
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxh32_intdigest(word) % BUCKETS
        hashed = np.fromiter((known[w] for w in words), np.int64, len(words))
        at, n = np.unique(hashed, return_counts=True)
        values = np.log1p(n)
        return at, values / (np.sqrt((values**2).sum()) or 1.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Problem:
    """What is fitted: entries ``x`` of rows at columns, grades, and the rows' weights.

    Parameters are the columns' weights, the first threshold, and the logarithms of
    the steps after it.
    """

    row: np.ndarray
    at: np.ndarray
    x: np.ndarray
    grades: np.ndarray
    weigh: np.ndarray
    columns: int
    cuts: int

    def edges(self, params: np.ndarray) -> np.ndarray:
        t = params[self.columns :]
        return np.concatenate([[-np.inf], t[:1], t[:1] + np.cumsum(np.exp(t[1:])), [np.inf]])

    def _sides(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logistic function at the lower and the upper threshold of each row's grade."""
        score = np.bincount(self.row, params[self.at] * self.x, len(self.grades))
        edges = self.edges(params)
        low, high = _sigmoid(edges[self.grades] - score), _sigmoid(edges[self.grades + 1] - score)
        return np.where(self.grades == 0, 0.0, low), np.where(self.grades == self.cuts, 1.0, high)

    def likelihood(self, params: np.ndarray) -> float:
        """The mean logarithm of the grades' chances, less the weights' squares."""
        low, high = self._sides(params)
        fit = (self.weigh * np.log(np.maximum(high - low, 1e-12))).mean()
        return float(fit - SHRINK / 2 * (params[: self.columns] ** 2).sum())

    def gradient(self, params: np.ndarray) -> np.ndarray:
        n = len(self.grades)
        low, high = self._sides(params)
        chance = np.maximum(high - low, 1e-12)
        of_low, of_high = -self.weigh * low * (1 - low) / chance, self.weigh * high * (1 - high) / chance
        to_score = -(of_low + of_high)
        to_edges = np.bincount(self.grades, of_low, self.cuts + 2)
        to_edges += np.bincount(self.grades + 1, of_high, self.cuts + 2)
        inner = to_edges[1 : self.cuts + 1]
        later = np.cumsum(inner[::-1])[::-1]
        weights = np.bincount(self.at, to_score[self.row] * self.x, self.columns) / n - SHRINK * params[: self.columns]
        steps = np.exp(params[self.columns + 1 :])
        return np.concatenate([weights, [inner.sum() / n], later[1:] * steps / n])


@dataclass(frozen=True)
class Ordinal:
    """Cumulative-link regression over the grades 0 to ``len(thresholds)``."""

    weights: np.ndarray
    thresholds: np.ndarray
    only: int = 0  # the grade, where the labels have one alone

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Ordinal:
        """Gradient ascent on the likelihood; classes weigh alike however rare."""
        if len(np.unique(grades)) < 2:
            return cls(np.zeros(BUCKETS, np.float32), np.zeros(0), int(grades[0]) if len(grades) else 0)
        cuts = int(grades.max())
        row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        at, x = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        common = np.bincount(at, minlength=BUCKETS) >= LEAST_TEXTS
        row, at, x = (v[common[at]] for v in (row, at, x))
        used, at = np.unique(at, return_inverse=True)
        sizes = np.bincount(grades, minlength=cuts + 1)
        weigh = (len(grades) / np.maximum(sizes, 1) / np.count_nonzero(sizes))[grades]
        problem = Problem(row, at, x, grades, weigh, len(used), cuts)
        params = np.zeros(len(used) + cuts)
        first, second = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            gradient = problem.gradient(params)
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            params = params + RATE * (first / (1 - 0.9**step)) / (
                np.sqrt(second / (1 - 0.999**step)) + 1e-8
            )
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = params[: len(used)]
        return cls(weights, problem.edges(params)[1:-1])

    def chances(self, score: float) -> np.ndarray:
        """The chance of each grade from 1 on, or more."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 700)))


def learn(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """A fit on the ``SAMPLE`` labels ``(doc_id, grade)`` whose keys have the least hashes.

    The sample's keys go to the texts, so texts aren't moved. They become sparse
    features in tasks, which are all that reaches the driver. Where labels only
    say whether a text is toxic, a first fit grades the toxic ones 1 or 2: those
    that it scores above their median are 2.
    """
    kind = pa.struct([("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for batch in batches:
            rows = [features(t) for t in batch.to_pylist()]
            yield pa.array([{"at": at, "x": x} for at, x in rows], kind)

    graded = labels.where("grade is not null and doc_id is not null").select("doc_id", "grade")
    hashed = graded.distinct().withColumn("h", F.xxhash64("doc_id", F.lit("sample")))
    sample = hashed.orderBy("h", "grade").limit(SAMPLE)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    features = F.arrow_udf(run, "at array<long>, x array<double>")("text")
    texts = texts.select("h", "grade", F.xxhash64("text").alias("t"), features.alias("f"))
    got = texts.orderBy("h", "grade", "t").limit(SAMPLE).toArrow()
    rows = [
        (np.array(f["at"], np.int64), np.array(f["x"], np.float64)) for f in got["f"].to_pylist()
    ]
    grades = np.array(got["grade"].to_pylist(), np.int64)
    model = Ordinal.fit(rows, grades)
    if set(grades.tolist()) == {0, 1}:
        scores = np.array([model.weights[at] @ x for at, x in rows])
        graded = np.where((grades == 1) & (scores > np.median(scores[grades == 1])), 2, grades)
        model = Ordinal.fit(rows, graded)
    return model


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """``(doc_id, severity, grade)``: expected severity, and the highest grade with an even chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, features = shared.value, Features()
        for batch in batches:
            severities, grades = [], []
            for t in batch.to_pylist():
                at, x = features(t)
                none = len(at) == 0
                chances = model.chances(-np.inf if none else float(model.weights[at] @ x))
                severities.append(model.only + float(chances.sum()))
                grades.append(model.only + int((chances >= 0.5).sum()))
            yield pa.StructArray.from_arrays(
                [pa.array(severities, pa.float64()), pa.array(grades, pa.int32())], ["severity", "grade"]
            )

    found = F.arrow_udf(run, "severity double, grade int")(F.col(text))
    return docs.select("doc_id", found.alias("_s")).select("doc_id", "_s.severity", "_s.grade")
