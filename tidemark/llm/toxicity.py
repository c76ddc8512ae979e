"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled texts train a linear classifier on hashed words. With the class prior ``p`` and the
toxic share ``q`` among the unlabelled texts the risk is ``p E+[l(f)] + (1 - p) / (1 - q) max(0, Eu[l(-f)] - q E+[l(-f)])``:
what unlabelled texts cost as negatives, less the toxic ones in them, and never below zero. Unlabelled are all texts that
are not confirmed as toxic, so ``q`` is what the prior leaves when those are taken out. Where a batch's second part falls below zero, the step goes the other way on that part alone,
so the model cannot gain by fitting single examples. ``l`` is the logistic loss, so the sigmoid of ``f`` is a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hashed import Adam, Rows, bounded_sample, collect_rows, remainder, scorer

BITS = 18
POSITIVES, UNLABELLED = 4096, 8192  # bounds of the training sample, in documents


@dataclass(frozen=True)
class Toxicity:
    weights: np.ndarray
    bias: float
    prior: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def evidence(positive: Rows, unlabelled: Rows, least: float, needed: int) -> np.ndarray:
    """How far each feature's share of positive texts differs from that of unlabelled ones, in deviations beyond ``least``.

    Features of fewer than ``needed`` texts or with less evidence are left out, so that chance words get no weight.
    """
    n, m = positive.n, unlabelled.n
    a, b = np.bincount(positive.slots, minlength=positive.width), np.bincount(unlabelled.slots, minlength=positive.width)
    share = np.clip((a + b) / (n + m), 1e-9, 1 - 1e-9)
    apart = np.maximum(0, np.abs(a / n - b / m) - 0.5 * (1 / n + 1 / m))
    z = apart / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return np.where(a + b >= needed, np.maximum(0, z - least), 0)


def fit(
    positive: Rows,
    unlabelled: Rows,
    prior: float,
    left: float | None = None,
    epochs: int = 100,
    rate: float = 0.3,
    decay: float = 1e-5,
    least: float = 3.0,
    needed: int = 4,
) -> Toxicity:
    """Full-batch steps on both samples; ``left``: the toxic share of the unlabelled one (default: the prior).

    Without positives every score is the prior. Positives without unlabelled texts are an error: nothing tells them apart.
    """
    weights = np.zeros(positive.width)
    bias = np.array([np.log(prior / (1 - prior))])
    if not positive.n:
        return Toxicity(weights, float(bias[0]), prior)
    if not unlabelled.n:
        raise ValueError("toxic examples but no other documents to learn from")
    left = prior if left is None else left
    part = (1 - prior) / (1 - left)
    scale = evidence(positive, unlabelled, least, needed)
    used = np.flatnonzero(scale)
    positive, unlabelled, scale = positive.only(used), unlabelled.only(used), scale[used]
    w = np.zeros(len(used))
    adam = Adam([w, bias], rate)
    for _ in range(epochs):
        fp, fu = positive.dot(w * scale) + bias, unlabelled.dot(w * scale) + bias
        sp, su = sigmoid(fp), sigmoid(fu)
        as_negative = np.logaddexp(0, fu).mean() - left * np.logaddexp(0, fp).mean()
        up, un = prior * (sp - 1) / positive.n, part * su / unlabelled.n
        off = -part * left * sp / positive.n
        gp, gu = (up + off, un) if as_negative >= 0 else (-off, -un)
        adam.step([scale * (positive.back(gp) + unlabelled.back(gu)) + decay * w, np.array([gp.sum() + gu.sum()])])
    weights[used] = w * scale
    return Toxicity(weights, float(bias[0]), prior)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Toxicity:
    """Learns from labelled toxic rows and other documents, from at most ``POSITIVES`` and ``UNLABELLED`` ids of each.

    ``prior``: the share of toxic texts; by default that among the labels given. Of the labels only the toxic ones are
    examples; all documents that are not confirmed toxic are the unlabelled side, whether a label clears them or not.
    Rows with a NULL id or label are not used; an id labelled twice counts as toxic if any label says so.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(max(share or 0.0, 0.001), 0.999)
    confirmed = known.where("toxic = 1").select("doc_id")
    toxic = bounded_sample(confirmed, POSITIVES).withColumn("toxic", F.lit(1))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    every, met = ids.join(confirmed.withColumn("_c", F.lit(1)), "doc_id", "left").agg(F.count(F.lit(1)), F.count("_c")).first()
    left = min(max((prior * every - met) / max(every - met, 1), 0.0005), prior)
    plain = bounded_sample(ids.join(confirmed, "doc_id", "left_anti"), UNLABELLED).withColumn("toxic", F.lit(0))
    got = collect_rows(docs, toxic.union(plain), BITS, False)
    pick = lambda m: Rows(*[[got[k][i] for i in np.flatnonzero(got["marks"] == m)] for k in ("slots", "values")], 1 << BITS)
    return fit(pick(1), pick(0), prior, left)


def score(spark: SparkSession, docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """Adds the probability of toxicity of the whole text; a NULL or wordless text has the score of no evidence."""
    weights, bias = spark.sparkContext.broadcast(model.weights.astype(np.float32)), model.bias
    return docs.withColumn(name, scorer(BITS, False, weights, lambda sums: sigmoid(sums + bias))("text"))


def train_part(df: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Rows that may be learned from: the CRC-32 of the id as text leaves another remainder than ``held_out``."""
    return df.where(remainder(F.col("doc_id"), folds) != held_out)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, learned from the rows that are not held out.

    A NULL id is not held out; a NULL text is scored as an empty one; repeated rows are each scored alike.
    """
    model = train(train_part(docs), train_part(labels))
    out = score(docs.sparkSession, docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
