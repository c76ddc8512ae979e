"""Quality by ordinal regression on graded ratings.

A cumulative-link model: ``P(grade <= k) = sigmoid(threshold_k - w x)`` with one weight vector over hashed words and token
shapes for all grades and thresholds kept in order (the first, then positive gaps). It gives each text its expected grade
and the probability of reaching a wanted grade, by which texts are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashed import Adam, Rows, bounded_sample, collect_rows, remainder, scorer
from tidemark.llm.toxicity import sigmoid, train_part

BITS = 18
RATED = 8192  # bound of the training sample, in documents


@dataclass(frozen=True)
class Ordinal:
    """``grades`` in ascending order; ``thresholds`` between them, one fewer."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def reaching(self, sums: np.ndarray) -> np.ndarray:
        """For each text and each grade but the lowest, the probability of that grade or a higher one."""
        return 1 - sigmoid(self.thresholds[None, :] - sums[:, None])

    def expected(self, sums: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.reaching(sums) @ np.diff(self.grades)


def fit(rows: Rows, grades: np.ndarray, epochs: int = 120, rate: float = 0.2, decay: float = 1e-5, needed: int = 4) -> Ordinal:
    """Full-batch steps on the likelihood of the ratings. With fewer than two grades there are no thresholds."""
    levels, y = np.unique(grades, return_inverse=True)
    weights = np.zeros(rows.width)
    if len(levels) < 2:
        return Ordinal(weights, np.empty(0), levels.astype(float) if len(levels) else np.zeros(1))
    used = np.flatnonzero(np.bincount(rows.slots, minlength=rows.width) >= needed)
    rows = rows.only(used)
    below = np.clip(np.cumsum(np.bincount(y))[:-1] / len(y), 1e-6, 1 - 1e-6)
    start = np.log(below / (1 - below))
    w, first, gaps = np.zeros(len(used)), start[:1].copy(), np.log(np.maximum(np.diff(start), 1e-3))
    adam = Adam([w, first, gaps], rate)
    for _ in range(epochs):
        cuts = np.concatenate([[-np.inf], first, first + np.cumsum(np.exp(gaps)), [np.inf]])
        sums = rows.dot(w)
        upper, lower = sigmoid(cuts[y + 1] - sums), sigmoid(cuts[y] - sums)
        p = np.maximum(upper - lower, 1e-9)
        slope = (1 - upper - lower) / rows.n
        at_upper, at_lower = -upper * (1 - upper) / p / rows.n, lower * (1 - lower) / p / rows.n
        by_cut = np.bincount(y + 1, at_upper, len(levels) + 1) + np.bincount(y, at_lower, len(levels) + 1)
        from_cut = np.cumsum(by_cut[1:-1][::-1])[::-1]  # a cut moves with the first one and with each gap below it
        adam.step([rows.back(slope) + decay * w, from_cut[:1], from_cut[1:] * np.exp(gaps)])
    weights[used] = w
    return Ordinal(weights, first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))]), levels.astype(float))


def train(docs: DataFrame, ratings: DataFrame, column: str) -> Ordinal:
    """Learns ``ratings[column]`` (whole numbers) from at most ``RATED`` rated documents; NULL ids and ratings are not used.

    An id rated more than once counts with its lowest rating.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rated = bounded_sample(rated.groupBy("doc_id").agg(F.min(column).alias("grade")), RATED)
    got = collect_rows(docs, rated, BITS, True)
    return fit(Rows(got["slots"], got["values"], 1 << BITS), got["marks"])


def graded(docs: DataFrame, model: Ordinal, wanted: float | None = None, least: float = 0.5) -> DataFrame:
    """Adds ``expected_grade``, ``tail_probability`` of ``wanted`` (default: the highest grade) or more, ``selected``.

    A text is selected if its tail probability is at least ``least``. NULL and wordless texts are scored like texts
    without evidence. The text is read once, by one UDF; everything else is arithmetic on its sum.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    sums = scorer(BITS, True, weights, lambda s: s)("text")
    wanted = model.grades[-1] if wanted is None else wanted
    reaching = [1 / (1 + F.exp(F.lit(float(t)) - F.col("_sum"))) for t in model.thresholds]
    expected = F.lit(float(model.grades[0]))
    for step, p in zip(np.diff(model.grades), reaching, strict=True):
        expected = expected + float(step) * p
    at = int(np.searchsorted(model.grades, wanted))
    tail = F.lit(1.0) if at == 0 else reaching[at - 1] if at <= len(reaching) else F.lit(0.0)
    out = docs.withColumn("_sum", sums).withColumns({"expected_grade": expected, "tail_probability": tail})
    return out.withColumn("selected", F.col("tail_probability") >= least).drop("_sum")


def quality_grades(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, selected`` of every row.

    Learned from rows whose CRC-32 of the id as text is not divisible by 5; those are held out. A NULL id is not.
    """
    model = train(train_part(docs), train_part(labels), column)
    return graded(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "expected_grade",
        "tail_probability",
        "selected",
    )
