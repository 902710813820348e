"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A text's features are the distinct words, the stems of longer words, pairs of
neighbours, and pairs with one word between them, hashed into BITS bits. Each
coordinate has its own learning rate; the L1 term keeps most weights at exactly zero, so that the
model travels as a short sorted table of (index, weight).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sample, WordHasher, bound_batches, fold, labelled_sample, mix, pick, pieces

BITS = 20
#: Labelled rows that training reads at most.
SAMPLE_ROWS = 12_000
FOLDS, HELD_OUT = 5, 0
#: Letters of a stem.
STEM = 6
_WORD = re.compile(r"\w+")
_HASH = WordHasher()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Feature indices of a whole text, with repeats."""
    words = _WORD.findall((text or "").lower())
    h = _HASH(words)
    parts = [mix(h), mix(_HASH([w[:STEM] for w in words if len(w) > STEM]) ^ np.uint64(STEM))]
    for gap in (1, 2):  # 1: neighbours, 2: skip-grams
        if len(h) > gap:
            parts.append(mix(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] ^ np.uint64(gap))))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class FtrlModel:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def train(
    rows: Sample | list[tuple[str, int]], bits: int = BITS, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, least: int = 3
) -> FtrlModel:
    """Fit on (text, 0 or 1) rows in the order given. Features of fewer than `least`
    texts are left out: the L1 term would hold them at zero. Without rows of both labels
    all weights are zero and the bias is the smoothed prior of label 1."""
    y = np.array([label == 1 for _, label in rows], float)
    prior = (y.sum() + 0.1) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < y.sum() < len(y):
        return FtrlModel(np.zeros(0, np.int64), np.zeros(0, np.float32), bias, bits)
    seen = np.zeros(1 << bits, np.int32)
    for t, _ in rows:
        seen[np.unique(features(t, bits))] += 1
    x = []  # made again, so that only the features that count are ever held
    for t, _ in rows:
        i = np.unique(features(t, bits))
        x.append(i[seen[i] >= least].astype(np.int32))
    _HASH.seen.clear()
    if isinstance(rows, Sample):
        rows.release()
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i, label in zip(x, y):
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            b = bias - zb * alpha / (beta + nb**0.5)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            # every feature has value 1, so the gradient is the same for all of them
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
            zb += g
            nb += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return FtrlModel(kept, w[kept].astype(np.float32), float(bias - zb * alpha / (beta + nb**0.5)), bits)


def score_texts(model: FtrlModel, dense: np.ndarray, texts: list[str | None]) -> np.ndarray:
    margin = np.full(len(texts), model.bias)
    for k, text in enumerate(texts):
        f = features(text, model.bits)
        f = f[dense[f] != 0]  # most weights are zero: only the others need to be made distinct
        margin[k] += dense[np.unique(f)].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def scorer(spark, model: FtrlModel):
    """A column function text -> score with the model broadcast (its size is bounded by 2**BITS weights)."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = sent.value.dense()
        for own in pieces(texts):
            yield pa.array(score_texts(sent.value, dense, own))

    return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FtrlModel:
    return train(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows))


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, held_out, score, predicted.

    Learns from labels (doc_id, toxic) outside the held-out fold only, at most
    `rows` of them. A null text scores as the empty one; a null doc_id belongs
    to the fold of the empty text; repeated rows stay repeated; an empty table
    gives an empty result; other columns are ignored.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, rows))
    scored = pick(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
