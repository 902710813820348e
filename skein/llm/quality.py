"""Quality grades by ordinal cumulative-link regression.

P(grade <= k) = sigmoid(threshold_k - margin): one weight vector over hashed
text features serves all grades, and the thresholds stay in order because
their gaps are exponentials. The expected grade and the probability of
reaching a grade follow from the margin.

Features: shares of hashed words, word shapes, neighbouring shapes and
repeated neighbours in the text, each family in BITS bits.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, Sample, bound_batches, fold, labelled_sample, mix, pick, pieces, use_cache

BITS = 14
#: Labelled rows that training reads at most.
SAMPLE_ROWS = 6_000
FOLDS, HELD_OUT = 5, 1
_SHAPES = [(re.compile(p), s) for p, s in ((r"[A-ZÀ-ÖØ-Þ]{2,}", "U"), (r"[A-ZÀ-ÖØ-Þ]", "u"), (r"[^\W\d_]+", "a"), (r"\d+", "0"))]
#: word -> hashes of the word and of its shape, packed
_SEEN: dict[str, bytes] = {}
#: Hashes of "differs from the word before" and "repeats it".
_SAME = mix(np.array([77, 78], np.uint64))


def _word(w: str) -> bytes:
    shape = w
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    of = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 17)
    return struct.pack("<QQ", of(w.lower()), of("shape " + shape[:12] + str(min(len(w) // 8, 4))))


def occurrences(text: str | None) -> tuple[np.ndarray, int]:
    """(indices of a whole text's features, with repeats; number of words)."""
    words = (text or "").split()
    use_cache(_SEEN, CACHE_WORDS)
    for w in words:
        if w not in _SEEN:
            _SEEN[w] = _word(w)
    both = np.frombuffer(b"".join(map(_SEEN.__getitem__, words)), "<u8").reshape(-1, 2)
    word, shape = both[:, 0], both[:, 1]
    same = (word[1:] == word[:-1]).astype(np.intp)
    parts = [word, shape, mix(shape[1:] * np.uint64(3) + shape[:-1]), _SAME[same]]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), len(words)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indices, shares) of a whole text's features; empty for a text without words."""
    index, n = occurrences(text)
    count = np.bincount(index, minlength=1 << BITS)
    index = np.flatnonzero(count)
    return index, (count[index] / max(n, 1)).astype(np.float32)


@dataclass
class OrdinalModel:
    weight: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades
    grades: list[int]

    def reach(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every grade but the lowest, one column each."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None], -35, 35)))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            index, n = occurrences(t)
            out[k] = self.weight[index].sum(dtype=np.float64) / max(n, 1)
        return out


def train(rows: Sample | list[tuple[str, int]], epochs: int = 6, rate: float = 0.5, l2: float = 1e-5, seed: int = 3) -> OrdinalModel:
    """Fit on (text, grade) rows by Adagrad. With fewer than two grades there is nothing to
    order: all weights are zero and every text has the one grade (or grade 0)."""
    grades = sorted({g for _, g in rows})
    weight = np.zeros(1 << BITS)
    if len(grades) < 2:
        return OrdinalModel(weight, np.zeros(0), grades or [0])
    y = np.array([grades.index(g) for _, g in rows])
    x = [features(t) for t, _ in rows]
    _SEEN.clear()
    if isinstance(rows, Sample):
        rows.release()
    n = len(grades) - 1
    share = np.clip([(y <= k).mean() for k in range(n)], 0.01, 0.99)
    start = np.log(share / (1 - share))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    seen, seen_t = np.full(1 << BITS, 1e-3), np.full(n, 1e-1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(x)):
            i, v = x[r]
            cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            p = 1 / (1 + np.exp(-np.clip(cuts - weight[i] @ v, -35, 35)))
            # likelihood of grade k: p[k] - p[k - 1], with 0 and 1 at the ends
            upper, lower = (p[y[r]] if y[r] < n else 1.0), (p[y[r] - 1] if y[r] else 0.0)
            like = max(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / like, lower * (1 - lower) / like
            g = (d_upper - d_lower) * v + l2 * weight[i]  # of the negative log-likelihood
            seen[i] += g * g
            weight[i] -= rate * g / np.sqrt(seen[i])
            cut_g = np.zeros(n)
            if y[r] < n:
                cut_g[y[r]] -= d_upper
            if y[r]:
                cut_g[y[r] - 1] += d_lower
            tail = np.cumsum(cut_g[::-1])[::-1]
            par_g = np.concatenate([[tail[0]], tail[1:] * np.exp(gaps)])
            seen_t += par_g * par_g
            move = 0.05 * par_g / np.sqrt(seen_t)
            first, gaps = first - move[0], gaps - move[1:]
    return OrdinalModel(weight.astype(np.float32), first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), grades)


def grade_table(labels: DataFrame) -> DataFrame:
    """Graded ratings of labels (doc_id, quality, toxic): 0 poor, 1 good but toxic, 2 good;
    null where quality is null; a null toxic counts as not toxic."""
    own = pick(labels, "doc_id", "quality", "toxic")
    good = F.col("quality") >= 1
    return own.select("doc_id", F.when(~good, 0).when(good & (F.col("toxic") == 1), 1).when(good, 2).alias("grade"))


def quality_grades(docs: DataFrame, graded: DataFrame, reach: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, held_out, expected_grade, tail_probability
    (of reaching grade `reach`), selected (that it is at least one half).

    Learns from graded (doc_id, grade) outside the held-out fold, at most `rows`
    of them. Null and empty texts have margin zero; a null doc_id belongs to the
    fold of the empty text; repeated rows stay repeated; an empty table gives an
    empty result; other columns are ignored.
    """
    model = train(labelled_sample(docs, graded, "grade", FOLDS, HELD_OUT, rows))
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade:double,tail_probability:double>")
    def grade(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        steps = np.diff(m.grades)
        above = [k for k, g in enumerate(m.grades[1:]) if g >= reach]
        for own in pieces(texts):
            p = m.reach(m.margins(own))
            tail = p[:, above[0]] if above and m.grades[0] < reach else np.full(len(own), float(m.grades[0] >= reach))
            yield pa.StructArray.from_arrays([pa.array(m.grades[0] + p @ steps), pa.array(tail)], names=["expected_grade", "tail_probability"])

    out = pick(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), grade("text").alias("r"))
    return out.select("doc_id", "held_out", "r.expected_grade", "r.tail_probability", (F.col("r.tail_probability") >= 0.5).alias("selected"))
