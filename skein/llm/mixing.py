"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised. The
exponent is found by bisection (in sections, so that one aggregation over the
source table tries many exponents): for a wanted entropy of the weights, or
for the most often that any document may be repeated.

The weights are realised as budgeted block permutations: each source's
documents are hashed into blocks, and each pass orders the blocks, and the
documents in them, by hashes of the pass. Full passes take all blocks; the
last one takes whole blocks until the source's budget is met. The block on the
edge is cut into slices of its order, taken whole in the same way, and only
the slice on the edge is ever ordered by document: a millionth of a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small as _sent
from .common import checkpoint, pick

#: Blocks of all sources together, about, and of one source at most.
BLOCKS, BLOCKS_OF_SOURCE = 65_536, 1_024
SECTIONS, ROUNDS = 32, 5
#: Slices of the order of a block on the edge, as bits.
SLICE_BITS = 10
SEED = 9
PASS, ORDER = "pass", "place"


@dataclass(frozen=True)
class Target:
    """What to reach; give one of entropy (nats) and repetition.

    keep_all sets the budget so that the source repeated least is taken exactly
    once, else it is the tokens there are times budget.
    """

    entropy: float | None = None
    repetition: float | None = None
    budget: float = 1.0
    keep_all: bool = False


def token_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \t\n\r\f\\x0B]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _measures(sources: DataFrame, exponents: list[float], target: Target) -> list[tuple[float, float]]:
    """(entropy, repetition) of the weights for each exponent, in one aggregation."""
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return [(0.0, 0.0)] * len(exponents)
    share = sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(total))
    aggs = []
    for k, a in enumerate(exponents):
        w = F.pow("p", F.lit(a))
        # sum w, sum w log w, and the largest and least w / p
        aggs += [F.sum(w).alias(f"s{k}"), F.sum(w * F.log(w)).alias(f"e{k}"), F.max(w / F.col("p")).alias(f"m{k}"), F.min(w / F.col("p")).alias(f"n{k}")]
    r = share.agg(*aggs).first()
    out = []
    for k in range(len(exponents)):
        sum_w = r[f"s{k}"]
        repeated = r[f"m{k}"] / r[f"n{k}"] if target.keep_all else r[f"m{k}"] / sum_w * target.budget
        out.append((math.log(sum_w) - r[f"e{k}"] / sum_w, repeated))
    return out


def fit_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent from 0 (equal weights) to 1 (natural shares) that meets the target, or the
    nearest end. Entropy and repetition both fall as the exponent grows."""
    if (target.entropy is None) == (target.repetition is None):
        raise ValueError("give either an entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        got = _measures(sources, tried, target)
        above = [(e > target.entropy) if target.entropy is not None else (r > target.repetition) for e, r in got]
        if not above[0]:
            return low
        if above[-1]:
            return high
        k = above.index(False)
        low, high = tried[k - 1], tried[k]
    return high


def plan(sources: DataFrame, exponent: float, target: Target) -> DataFrame:
    """sources (source, tokens) -> also weight, budget, passes (full ones), rest (tokens of the
    last pass), blocks. A source without tokens has weight 0 and one full pass."""
    p = F.col("tokens") / F.lit(sources.agg(F.sum("tokens")).first()[0] or 1)
    w = F.when(F.col("tokens") > 0, F.pow(p, F.lit(exponent))).otherwise(0.0)
    out = sources.withColumn("w", w)
    sum_w, least = out.where("tokens > 0").agg(F.sum("w"), F.min(F.col("w") / p)).first()
    out = out.withColumn("weight", F.col("w") / F.lit(sum_w or 1.0))
    whole = F.col("w") / p / F.lit(least or 1.0) if target.keep_all else F.col("weight") / p * target.budget
    times = F.when(F.col("tokens") > 0, F.round(whole, 9)).otherwise(1.0)
    out = out.withColumn("times", times).withColumn("passes", F.floor("times").cast("int"))
    return out.select(
        "source", "tokens", "weight", (F.col("times") * F.col("tokens")).alias("budget"), "passes", ((F.col("times") - F.col("passes")) * F.col("tokens")).alias("rest"),
        F.least(F.lit(BLOCKS_OF_SOURCE), F.ceil(F.coalesce(p, F.lit(0.0)) * BLOCKS) + 1).cast("int").alias("blocks"),
    )


def mix(docs: DataFrame, target: Target, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of docs, a row for each time that a document is taken, and pass int (from 0),
    block int and place long: passes ordered by (place, doc_id) run through a permutation
    of the source's documents by blocks.

    A null source is a source of its own; a null text has no tokens and is taken
    with its block; a source without tokens is taken once; repeated rows are
    separate documents of the same place; an empty table gives an empty result. A
    document on the edge is taken if its pass still lacks tokens before it, so a
    source exceeds its budget by less than a document. Columns of docs named
    pass, block or place are replaced.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    col = lambda n: F.col(f"c{names.index(n)}")
    rows = plain.withColumn("s", F.coalesce(F.concat(F.lit("="), col(source)), F.lit(""))).withColumn("key", F.coalesce(col(doc_id).cast("string"), F.lit("")))
    # words are counted once, into a narrow table
    counted = checkpoint(rows.select("s", "key", token_count(col(text)).alias("t")))
    sources = checkpoint(counted.groupBy(F.col("s").alias("source")).agg(F.sum("t").alias("tokens")))
    chosen = _sent(checkpoint(plan(sources, fit_exponent(sources, target), target))).select(F.col("source").alias("s"), "passes", "rest", "blocks")
    block = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("blocks")).cast("int")
    # a document's place in its block's order in the last pass
    place_in = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "passes", "key"), 44)
    part = F.shiftright(place_in, 20 - SLICE_BITS).cast("int")
    small = counted.join(chosen, "s").withColumn("b", block)

    def cut(table: DataFrame, left: Column, order: list[Column]) -> DataFrame:
        """table (s, ..., bt) of pieces in order: left for each, whether it is taken whole, or on the edge."""
        before = F.sum("bt").over(Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return table.withColumn("left", left - F.coalesce(before, F.lit(0))).withColumn("whole", (F.col("left") > 0) & (F.col("bt") <= F.col("left"))).withColumn("edge", (F.col("left") > 0) & (F.col("bt") > F.col("left")))

    # of the last pass: which blocks are taken whole, and what is left for the one on the edge
    by_block = small.groupBy("s", "b").agg(F.sum("t").alias("bt"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    by_block = checkpoint(cut(by_block, F.col("rest"), [F.xxhash64(F.lit(SEED), "passes", "s", "b"), F.col("b")]).select("s", "b", "left", "whole", "edge"))
    on_edge = _sent(by_block.where("edge").select("s", "b", F.col("left").alias("rest_of_block")))
    by_slice = small.join(on_edge, ["s", "b"]).groupBy("s", "b", part.alias("part")).agg(F.sum("t").alias("bt"), F.first("rest_of_block").alias("rest_of_block"))
    by_slice = checkpoint(cut(by_slice, F.col("rest_of_block"), [F.col("part")]).where("left > 0").select("s", "b", "part", F.col("left").alias("rest_of_slice"), F.col("whole").alias("slice_whole")))
    rows = rows.join(chosen, "s").withColumn("b", block).join(_sent(by_block.select("s", "b", "whole", "edge")), ["s", "b"])

    def taken(part: DataFrame, passes: Column) -> DataFrame:
        out = part.withColumn("k", F.explode(passes))
        place = F.shiftright(F.xxhash64(F.lit(SEED), "k", "s", "b"), 1).bitwiseAND(~0xFFFFF) + F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "k", "key"), 44)
        made = {PASS: F.col("k"), "block": F.col("b"), ORDER: place}
        keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in made]
        return out.select(*keep, *(c.alias(n) for n, c in made.items()))

    counted_passes = F.col("passes") + F.col("whole").cast("int")
    full = taken(rows, F.when(counted_passes > 0, F.sequence(F.lit(0), counted_passes - 1)).otherwise(F.array().cast("array<int>")))
    edge = rows.where("edge").withColumn("part", part).join(_sent(by_slice), ["s", "b", "part"])
    in_slice = Window.partitionBy("s", "b", "part").orderBy(place_in, "key").rowsBetween(Window.unboundedPreceding, -1)
    last = edge.where("not slice_whole").withColumn("t", token_count(col(text))).withColumn("had", F.coalesce(F.sum("t").over(in_slice), F.lit(0))).where("had < rest_of_slice")
    return full.union(taken(edge.where("slice_whole"), F.array("passes"))).union(taken(last, F.array("passes")))


def mixed(docs: DataFrame, target: Target) -> DataFrame:
    """doc_id, source, pass, block, place of every taken document, without its text. Nulls, empty and very
    long texts, repeated rows and empty tables are as in mix: whole texts are counted; columns of docs
    with these names, or with others that differ by case, are not read."""
    slim = pick(docs, "doc_id", "text", "source")
    return mix(slim, target).select("doc_id", "source", PASS, "block", ORDER)
