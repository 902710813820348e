"""Language identification by a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that together cover
all of it. Each byte has a learned vector; filters of several widths slide
over the window, each keeps its largest response, and a softmax layer gives
the window's language distribution. The text's distribution is the mean of
the log-probabilities of its windows, renormalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sample, bound_batches, broadcast_if_small, checkpoint, fold, pick, pieces, texts_of

WINDOW = 192
WIDTHS = (2, 3, 5)
FILTERS = 8
EMBED = 6
#: Windows in one matrix product; bounds the memory of a step at some 10 MB.
STEP = 256
FOLDS, HELD_OUT = 4, 2
#: Training reads at most so many texts of a language and in all, and windows of a text.
PER_LANGUAGE, SAMPLE_ROWS, WINDOWS_OF_TEXT = 400, 6_000, 6
UNKNOWN = "und"


def windows_of(data: bytes) -> np.ndarray:
    """uint8 matrix of all windows of a text, the last one padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # (widest * EMBED) x filters; narrow filters have zeros below
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, x: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        padded = np.zeros((len(x), WINDOW + wide - 1), np.uint8)
        padded[:, :WINDOW] = x
        e = self.embed[padded]
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, wide * EMBED), (s[0], s[1], s[2]))
        return view.reshape(len(x) * WINDOW, wide * EMBED)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return (self.patches(x) @ self.conv).reshape(len(x), WINDOW, -1).max(axis=1) + self.conv_bias

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), STEP):
            logits = np.maximum(self.pooled(x[at : at + STEP]), 0) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(parts)


def _masks() -> np.ndarray:
    wide = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(wide * EMBED) < w * EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)


def train(rows: Sample | list[tuple[str, str]], epochs: int = 8, rate: float = 0.004, batch: int = 64, seed: int = 5) -> ByteCnn:
    """Fit on (text, language) rows with Adam; no rows give a network without languages."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    wide, width = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = _masks()
    init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    net = ByteCnn(langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), init(wide * EMBED, width) * mask, np.zeros(width, np.float32), init(width, max(1, len(langs))), np.zeros(max(1, len(langs)), np.float32))
    if not langs:
        return net
    xs, ys = [], []
    for text, lang in rows:
        w = windows_of(text.encode("utf-8", "surrogatepass"))
        chosen = rng.permutation(len(w))[:WINDOWS_OF_TEXT]
        xs.append(w[chosen])
        ys += [langs.index(lang)] * len(chosen)
    x, y = np.concatenate(xs), np.array(ys)
    params = [net.embed, net.conv, net.conv_bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            n = len(xb)
            col = net.patches(xb)
            z = (col @ net.conv).reshape(n, WINDOW, width)
            best = z.argmax(axis=1)
            pooled = np.take_along_axis(z, best[:, None], 1)[:, 0] + net.conv_bias
            h = np.maximum(pooled, 0)
            logits = h @ net.out + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            dh = (p @ net.out.T) * (pooled > 0)
            # only the winning position of each filter passes a gradient on
            hit = col.reshape(n, WINDOW, -1)[np.arange(n)[:, None], best]
            dconv = np.einsum("nf,nfk->kf", dh, hit) * mask
            dpatch = (dh[:, :, None] * net.conv.T[None]).reshape(n, width, wide, EMBED)
            padded = np.zeros((n, WINDOW + wide - 1), np.int64)
            padded[:, :WINDOW] = xb
            which = padded[np.arange(n)[:, None, None], best[:, :, None] + np.arange(wide)].ravel()
            flat = dpatch.reshape(-1, EMBED)
            dembed = np.stack([np.bincount(which, flat[:, k], 256) for k in range(EMBED)], axis=1)
            step += 1
            for k, g in enumerate((dembed, dconv, dh.sum(axis=0), h.T @ p, p.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: ByteCnn, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text; `und` and 0 for a text that is null or has no letter."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not net.langs:
        return langs, scores
    known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    at = 0
    while at < len(known):
        parts, first, rows = [], at, 0
        while at < len(known) and rows < 4 * STEP:  # short texts share a step, a long one is a step of its own
            parts.append(windows_of(texts[known[at]].encode("utf-8", "surrogatepass")))
            rows += len(parts[-1])
            at += 1
        log_p = net.log_probs(np.concatenate(parts))
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        mean = np.add.reduceat(log_p, starts, axis=0) / np.array([len(p) for p in parts])[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k, row in zip(known[first:at], p):
            langs[k], scores[k] = net.langs[int(row.argmax())], float(row.max())
    return langs, scores


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> Sample:
    """The bounded training sample, chosen by a hash of the id outside the held-out fold."""
    keyed = pick(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    # the counts say which hashes can be among a language's first; the others never meet in a task
    ids = keyed.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    reach = ids.groupBy("lang").agg((F.lit(3.0 * per_language + 100) / F.count("*")).alias("reach"))
    near = ids.join(broadcast_if_small(checkpoint(reach)), "lang").where(F.shiftrightunsigned("h", 11) * 2.0**-53 < F.col("reach"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "doc_id"))).where(F.col("rank") <= per_language)
    chosen = ranked.orderBy("rank", "lang").limit(rows).select("doc_id", "lang").distinct()
    return texts_of(keyed, chosen, "lang", rows)


def identifier(spark, net: ByteCnn):
    """A column function text -> struct(lang_pred, score); the broadcast network has some thousand weights."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in pieces(texts):
            langs, scores = predict(sent.value, own)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return identify


def identify_languages(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang outside the held-out fold. A text that is
    null or has no letter is `und` with score 0, as is every text if nothing can
    be learned; of equally likely languages the first in the alphabet counts; a null
    doc_id belongs to the fold of the empty text; repeated rows stay repeated; an empty table gives an empty result; other columns are
    ignored.
    """
    identify = identifier(docs.sparkSession, train(sample(docs)))
    out = pick(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), identify("text").alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score")
