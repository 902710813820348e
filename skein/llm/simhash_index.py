"""SimHash fingerprints and near-duplicate search with a Gray-order hierarchical index.

Fingerprints: whole text, A-Z lower-cased, words between ASCII white space,
shingles of some words with repeats, XXH64 (seed 42) of each, a bit is set
where over half of the hashes have it. Null text counts as empty; no word
gives fingerprint zero.

Search within a radius of r bits, exact, over all distinct fingerprints: the
bits are cut into r + 1 blocks, and two fingerprints within r bits agree on
one of them. So there is an index for each block: fingerprints with that block
in front, sorted by Gray rank, range-partitioned by the rank of the block.
Each partition builds trees over its range and joins them with themselves;
upper nodes hold the bits that all below share, and a pair of nodes is dropped
with all below it once the differences on those bits add up to more than r.

A block value of more than KEY_ROWS fingerprints is refined: its open bits are
cut into r + 1 blocks again, and so on until few bits are open. Equal
fingerprints are merged before, so no key outgrows a task, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, pick, pieces
from .components import connected_components

SEED = 42
FANOUT = 8
#: Most fingerprints of a key before it is refined, and open bits below which it is not.
KEY_ROWS, LEAST_OPEN = 50_000, 20
#: Fingerprints of a tree, about, and pairs of nodes that its join holds at once.
TREE_ROWS, PAIRS = 150_000, 200_000
ALL = (1 << 64) - 1


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    parts = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), k)
    if not parts:
        return 0
    ones, n = np.zeros(64, np.int64), len(parts)
    for at in range(0, n, 65536):
        h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts[at : at + 65536]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the fingerprint's 64 bits, signed."""

    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in pieces(texts):
            yield pa.array(np.array([fingerprint(t, k) for t in own], np.uint64).view(np.int64))

    bound_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").select("doc_id", of("text").alias("fp"))


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the binary reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def runs_of(mask: int) -> list[tuple[int, int]]:
    """(lowest bit, length) of the runs of set bits, highest first."""
    out, bit = [], 64
    while bit:
        bit -= 1
        if mask >> bit & 1:
            high = bit
            while bit and mask >> (bit - 1) & 1:
                bit -= 1
            out.append((bit, high - bit + 1))
    return out


def fronted(values: np.ndarray, mask: int) -> np.ndarray:
    """The values with the bits of mask moved to the front, in order."""
    out = np.zeros(len(values), np.uint64)
    for low, length in runs_of(mask) + runs_of(ALL & ~mask):
        out = (out << np.uint64(length % 64)) | ((values >> np.uint64(low)) & np.uint64((1 << length) - 1))
    return out


class GrayIndex:
    """Tree over distinct fingerprints in Gray order, the bits of mask in front.

    Each node keeps the bits on which everything below it agrees and their
    values; the root has the bits that all share, children add what is left. Two
    nodes differ by at least the differences on the bits that both fix, and by
    at most those plus the bits that one leaves open.
    """

    def __init__(self, values: np.ndarray, mask: int = 0):
        values = np.unique(values)
        self.mask = np.uint64(mask)
        self.values = values[np.argsort(gray_rank(fronted(values, mask)), kind="stable")]
        #: Pairs of leaves that joins have compared.
        self.compared = 0
        ones = zeros = self.values
        self.levels = [(ones, zeros)]  # AND and OR of what is below, leaves first
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
            self.levels.append((ones, zeros))

    def _children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parents' places, i, j) of the pairs of children of pairs of nodes, each pair once."""
        step, n = np.arange(FANOUT), len(self.levels[level - 1][0])
        of = np.arange(len(i)).repeat(FANOUT * FANOUT)
        ci = (i[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, 2).ravel()
        cj = (j[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, 1).ravel()
        ok = (ci < n) & (cj < n) & (ci <= cj)
        return of[ok], ci[ok], cj[ok]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i < j) of linked leaves that agree on mask, in slices. Going down, a pair
        of nodes adds the differences on the bits that both fix and their parents did not.
        A pair that is within the radius as a whole gives a star instead of all its
        pairs, so the result has the components of all links, not all of the links."""
        one = np.zeros(1, np.int64)
        work = [(len(self.levels) - 1, one, one, one.astype(np.uint64), one)]
        while work:
            level, i, j, seen, differ = work.pop()
            if len(i) > PAIRS:
                half = len(i) // 2
                work += [(level, i[at], j[at], seen[at], differ[at]) for at in (slice(half, None), slice(half))]
                continue
            ones, zeros = self.levels[level]
            same = ~(ones ^ zeros)
            fixed, gap = same[i] & same[j], ones[i] ^ ones[j]
            differ = differ + np.bitwise_count(gap & fixed & ~seen)
            keep = (differ <= radius) & (gap & fixed & self.mask == 0)
            if level == 0:
                self.compared += int(np.count_nonzero(i < j))
                keep &= i < j
                yield i[keep], j[keep]
                continue
            i, j, fixed, differ = i[keep], j[keep], fixed[keep], differ[keep]
            whole = (differ + np.bitwise_count(~fixed) <= radius) & (~fixed & self.mask == 0)
            width = FANOUT**level
            for a, b in zip(i[whole].tolist(), j[whole].tolist()):
                at, bt = a * width, b * width
                rest = np.r_[at : min(at + width, len(self.values)), bt : min(bt + width, len(self.values))]
                rest = np.unique(rest)[1:]
                yield np.full(len(rest), at), rest
            i, j, fixed, differ = i[~whole], j[~whole], fixed[~whole], differ[~whole]
            each = max(1, PAIRS // FANOUT**2)
            for at in range(0, len(i), each):
                own = slice(at, at + each)
                of, ci, cj = self._children(level, i[own], j[own])
                work.append((level - 1, ci, cj, fixed[own][of], differ[own][of]))

    def within(self, value: np.uint64, radius: int) -> np.ndarray:
        """Positions of the leaves within the radius of a value, whatever the mask."""
        i, seen, differ = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ones, zeros = self.levels[level]
            fixed = ~(ones[i] ^ zeros[i])
            differ = differ + np.bitwise_count((ones[i] ^ value) & fixed & ~seen)
            keep = differ <= radius
            i, differ, fixed = i[keep], differ[keep], fixed[keep]
            if level == 0:
                break
            children = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            ok = children < len(self.levels[level - 1][0])
            i, differ, seen = children[ok], np.repeat(differ, FANOUT)[ok], np.repeat(fixed, FANOUT)[ok]
        return i


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links between n places that join something new."""
    parent = np.arange(n)
    kept: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in links:
        a, b = parent[i], parent[j]
        new = a != b
        if not new.any():
            continue
        _, first = np.unique(np.minimum(a, b)[new] * n + np.maximum(a, b)[new], return_index=True)
        for u, v in zip(i[new][first].tolist(), j[new][first].tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((u, v))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    out = np.array(kept, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def blocks(mask: int, radius: int) -> list[int]:
    """mask with one of radius + 1 blocks of its open bits added, for each of them."""
    open_bits = [k for k in range(63, -1, -1) if not mask >> k & 1]
    n = radius + 1
    edges = [len(open_bits) * k // n for k in range(n + 1)]
    return [mask | sum(1 << k for k in open_bits[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def _finer(rows: DataFrame, radius: int) -> DataFrame:
    """fp, mask -> fp, mask, rank: each fingerprint with its Gray rank in the indexes whose
    masks add a block to its mask."""

    @F.arrow_udf("array<struct<mask:long,rank:long>>")
    def placed(fps: pa.Array, masks: pa.Array) -> pa.Array:
        fp, mask = fps.to_numpy(zero_copy_only=False).view(np.uint64), masks.to_numpy(zero_copy_only=False)
        out_mask, out_rank = (np.empty((len(fp), radius + 1), np.int64) for _ in range(2))
        for m in np.unique(mask).tolist():
            own = mask == m
            for k, finer in enumerate(blocks(m & ALL, radius)):
                front = fronted(fp[own], finer) >> np.uint64(64 - finer.bit_count())
                out_mask[own, k], out_rank[own, k] = _signed(finer), gray_rank(front).view(np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(out_mask.ravel()), pa.array(out_rank.ravel())], names=["mask", "rank"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * (radius + 1), pa.int32()), pairs)

    return rows.select("fp", F.inline(placed("fp", "mask")))


def _dealt(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, mask, rank of every fingerprint in the index of each block, refined where a key has
    more than KEY_ROWS. Every level fixes another block, so there are few levels."""
    level, done = blocks(0, radius)[0], []
    rows = checkpoint(_finer(nodes.select("fp", F.lit(0).cast("long").alias("mask")), radius))
    while 64 - level.bit_count() > LEAST_OPEN:
        big = rows.groupBy("mask", "rank").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select("mask", "rank")
        big = checkpoint(big)
        if big.isEmpty():
            break
        done.append(rows.join(big, ["mask", "rank"], "left_anti"))
        rows = checkpoint(_finer(rows.join(big, ["mask", "rank"], "left_semi").select("fp", "mask"), radius))
        level = blocks(level, radius)[0]
    for part in done:
        rows = rows.unionByName(part)
    return rows


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (fp, distinct) -> (u, v): links that connect the same components as all
    pairs within the radius do."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)  # rows of keys that may go on

        def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for mask in np.unique(rows[:, 1]):
                own = rows[rows[:, 1] == mask, 0].view(np.uint64)
                index = GrayIndex(own, int(mask) & ALL)
                i, j = forest(len(index.values), index.links(radius))
                cat = lambda x: pa.array(index.values[x].view(np.int64))
                yield pa.RecordBatch.from_arrays([cat(i), cat(j)], names=["u", "v"])

        for batch in batches:
            own = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            held = np.concatenate([held, own])
            if len(held) > TREE_ROWS:
                last = (held[:, 1:] == held[-1, 1:]).all(axis=1)
                if not last.all():
                    yield from joined(np.ascontiguousarray(held[~last]))
                    held = held[last]
        yield from joined(np.ascontiguousarray(held))

    dealt = _dealt(nodes, radius).repartitionByRange("mask", "rank").sortWithinPartitions("mask", "rank")
    return dealt.select("fp", "mask", "rank").mapInArrow(search, "u long, v long").distinct()


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most radius bits reach.
    A null text counts as empty; empty texts share fingerprint zero and link like
    any other. The fingerprints' links come from the Gray-order index and are exact.
    Rows with a null doc_id take part and get their component's
    smallest id (null if it has none); repeated rows stay repeated. An empty
    table gives an empty result; other columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, k))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
