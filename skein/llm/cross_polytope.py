"""Approximate nearest neighbours by cross-polytope hashing.

A hash function turns a vector by three rounds of random signs and a fast
Hadamard transform and names the nearest signed axis; a table's bucket joins
the names of some functions. A query probes in each table the buckets whose
axes it is nearest to, and the vectors found in any of them are ranked by their
exact Euclidean distance.

The vectors are dealt into blocks of bounded size, once each; a block's tables
are built where it lies, and the queries, a hundredth of the rows or so, stream
through every block. So no vector is copied for a table or a probe, a
candidate that many tables find is compared once, and no row is made for a
pair that is merely compared. Equal vectors are one class, so no bucket holds
copies.

The number of functions follows from the number of vectors (a bucket holds a few);
the number of probes is fitted to the true neighbours, among all vectors, of a
bounded sample of queries.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick

TABLES = 48
#: Wanted number of vectors in a bucket, and functions of a table at least.
BUCKET_WANTED, LEAST_FUNCTIONS = 4, 2
#: Bytes of vectors (float32) in a block at most, about (its tables take half as much again), and
#: vectors that a block has at least if there are fewer blocks than shuffle partitions.
BLOCK_BYTES, BLOCK_ROWS = 64 << 20, 2_000
#: Queries of the sample that fits the number of probes, and the recall it must reach there.
SAMPLE_QUERIES, SAMPLE_RECALL = 128, 0.95
#: Queries that probe together.
STEP = 64
#: Longest vectors that are rotated by a matrix.
MATRIX_DIM = 256
MOST_PROBES = 2_048
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(math.sqrt(d))


def rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Pseudo-rotation of unit rows, padded with zeros to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table, function, d])
    for _ in range(3):
        y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), d))
    return y


@functools.lru_cache(256)
def _rotation(table: int, function: int, dim: int) -> np.ndarray:
    return rotated(np.eye(dim, dtype=np.float32), table, function)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def signed_axes(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Nearness of each unit row to all 2d signed axes of a function."""
    # the transform is linear: for short vectors one product with its matrix is the faster way
    y = x @ _rotation(table, function, x.shape[1]) if x.shape[1] <= MATRIX_DIM else rotated(x, table, function)
    return np.concatenate([y, -y], axis=1)


def codes_of(x: np.ndarray, table: int, functions: int) -> np.ndarray:
    """The bucket of each unit row in a table: its functions' nearest signed axes in base 2d."""
    code = np.zeros(len(x), np.int64)
    for f in range(functions):
        near = signed_axes(x, table, f)
        code = code * near.shape[1] + near.argmax(axis=1)
    return code


@functools.lru_cache(64)
def _corner(rows: int, columns: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of a table, both ways descending, that can be among its `most` largest sums."""
    i, j = np.arange(rows), np.arange(columns)
    return np.nonzero((i[:, None] + 1) * (j[None] + 1) <= most)


def probed(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """The `probes` buckets of each unit row with the largest summed nearness to their axes, nearest
    first (fewer if there are fewer)."""
    n = len(x)
    code, worth = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
    for f in range(functions):
        near = signed_axes(x, table, f)
        axis = np.argsort(-near, axis=1, kind="stable")
        near = np.take_along_axis(near, axis, 1)
        i, j = _corner(worth.shape[1], near.shape[1], probes)
        code, worth = code[:, i] * near.shape[1] + axis[:, j], worth[:, i] + near[:, j]
        keep = np.argsort(-worth, axis=1, kind="stable")[:, :probes]
        code, worth = np.take_along_axis(code, keep, 1), np.take_along_axis(worth, keep, 1)
    return code


def functions_for(n: int, dim: int) -> int:
    """Hash functions that give n vectors buckets of about BUCKET_WANTED."""
    d = 1 << max(0, dim - 1).bit_length()
    return max(LEAST_FUNCTIONS, round(math.log(max(n / BUCKET_WANTED, 1)) / math.log(2 * d)))


def fit_probes(queries: np.ndarray, neighbours: list[np.ndarray], functions: int) -> tuple[int, int]:
    """(functions, probes): the least number of probes a table with which SAMPLE_RECALL of the
    queries' true neighbours share a probed bucket with them in some table. Where MOST_PROBES
    are too few, buckets get wider by a function less; with one function all of them, two for
    each padded component, can be probed. queries: rows; neighbours: rows for each query."""
    if not sum(map(len, neighbours)):
        return functions, 1
    x = unit(queries)
    sizes = list(map(len, neighbours))
    owner = np.repeat(np.arange(len(x)), sizes)
    near = unit(np.concatenate([n for n in neighbours if len(n)]))
    most = MOST_PROBES if functions > 1 else 2 << max(0, x.shape[1] - 1).bit_length()
    place = np.full(len(near), most)
    for t in range(TABLES):
        own = codes_of(near, t, functions)
        lists = np.concatenate([probed(x[at : at + STEP], t, functions, most) for at in range(0, len(x), STEP)])
        for at in range(0, len(near), STEP):
            hit = lists[owner[at : at + STEP]] == own[at : at + STEP, None]
            place[at : at + STEP] = np.minimum(place[at : at + STEP], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    worst = int(np.sort(place)[math.ceil(SAMPLE_RECALL * len(place)) - 1])
    if worst == most and functions > 1:
        return fit_probes(queries, neighbours, functions - 1)
    return functions, min(most, worst + 1)


class Block:
    """The tables over some vectors of one length, held by one task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, functions: int, probes: int):
        self.ids, self.vectors, self.functions, self.probes = ids, vectors, functions, probes
        #: Vectors compared with queries so far.
        self.compared = 0
        x = unit(vectors)
        self.tables = []
        for t in range(TABLES):
            code = codes_of(x, t, functions)
            order = np.argsort(code, kind="stable").astype(np.int32)
            self.tables.append((code[order], order))

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, distances) of each query's k nearest candidates by (distance, id), in double precision."""
        found = np.zeros(len(self.ids), bool)
        for at in range(0, len(queries), STEP):
            own = queries[at : at + STEP]
            x = unit(own)
            lists = [probed(x, t, self.functions, self.probes) for t in range(TABLES)]
            for r, q in enumerate(own):
                for (code, order), wanted in zip(self.tables, lists):
                    low, high = np.searchsorted(code, wanted[r], "left"), np.searchsorted(code, wanted[r], "right")
                    size = high - low
                    some = size > 0
                    low, size = low[some], size[some]
                    ends = np.cumsum(size)
                    if len(ends):
                        found[order[np.arange(ends[-1]) + np.repeat(low - ends + size, size)]] = True
                near = np.flatnonzero(found)
                found[near] = False
                self.compared += len(near)
                yield nearest(q, self.ids[near], self.vectors[near], k)


def nearest(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest vectors by (distance, id), in double precision."""
    d = np.sqrt(((vectors.astype(np.float64) - query) ** 2).sum(axis=1))
    if len(d) > k:
        close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        ids, d = ids[close], d[close]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def nearest_of_all(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As nearest, of all vectors for each query, by products of matrices."""
    data = vectors.astype(np.float64)
    squares = (data * data).sum(axis=1)
    for at in range(0, len(queries), STEP):
        own = queries[at : at + STEP].astype(np.float64)
        rough = squares[None] + (own * own).sum(axis=1)[:, None] - 2 * (own @ data.T)
        for q, row in zip(own, rough):
            close = slice(None)
            if len(data) > k:
                close = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-9 * (squares.max() + q @ q))
            yield nearest(q, ids[close], data[close], k)


def _streamed(index: DataFrame, queries: DataFrame, k: int, blocks: Column, plan: dict[int, tuple[int, int]] | None) -> DataFrame:
    """index (cid, v, dim, block) and queries (cid, v, dim) -> asked, cid, score: the k nearest of each block
    that its tables find, or of all its vectors if plan (dim -> functions, probes) is None. Queries
    go to every block of their dim (blocks: how many), as rows that follow the block's own."""
    sent = queries.select("cid", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("asks"))
    both = index.select("cid", "v", "dim", "block", F.lit(False).alias("asks")).unionByName(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            at = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "asks")]
            edges = np.r_[0, 1 + np.flatnonzero((at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1]) | (at[2][1:] != at[2][:-1])), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if key != (new := (int(at[0][a]), int(at[1][a]))):
                    key, held, block = new, [], None
                rows = batch.slice(a, b - a)
                ids = rows.column("cid").to_numpy(zero_copy_only=False)
                vectors = np.asarray(rows.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), key[0])
                if not at[2][a]:
                    held.append((ids, vectors))
                    continue
                if block is None:
                    if not held:
                        continue
                    own = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    block, held = (Block(*own, *plan[key[0]]) if plan else own), []
                found = block.search(vectors, k) if plan else nearest_of_all(vectors, *block, k)
                ends, out = [], []
                for i, d in found:
                    ends.append(len(i))
                    out.append((i, d))
                cat = lambda parts, kind: pa.array(np.concatenate(parts), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ends), pa.int64()), cat([i for i, _ in out], pa.int64()), cat([d for _, d in out], pa.float64())], names=["asked", "cid", "score"])

    dealt = both.repartition("dim", "block").sortWithinPartitions("dim", "block", "asks")
    return dealt.select("cid", "v", "dim", "block", "asks").mapInArrow(run, "asked long, cid long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each asked class; a block has given k at most."""
    near = Window.partitionBy("asked").orderBy("score", "cid")
    return found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).drop("n")


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k nearest other rows that the
    index finds, by Euclidean distance in double precision, ties to the smaller id.

    is_query is a column over vec_id. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null id, take no part; vectors
    of other lengths are never neighbours; repeated rows (same id and vector)
    count once; an empty table gives an empty result; other columns are ignored.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = pick(vectors, id_col, vector_col).toDF("vec_id", "v").where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + zero)).where(sound).dropDuplicates(["vec_id", "v"])
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = checkpoint(classes.withColumn("cid", F.col("ids")[0]).withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return _empty(vectors, id_col)
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = {dim: max(math.ceil(n * dim * 4 / BLOCK_BYTES), min(least, math.ceil(n / BLOCK_ROWS))) for dim, n in sizes.items()}
    blocks = F.coalesce(*[F.when(F.col("dim") == dim, F.lit(n).cast("long")) for dim, n in shares.items()])
    index = classes.select("cid", "v", "dim", F.pmod(F.xxhash64("cid"), blocks).alias("block"))

    # probes: fitted to the exact neighbours of a few classes among all
    sample = classes.select("cid", "v", "dim").orderBy(F.xxhash64("cid")).limit(SAMPLE_QUERIES)
    best = _best(_streamed(index, sample, k + 1, blocks, None), k + 1).where("asked <> cid")
    pairs = best.join(sample.select(F.col("cid").alias("asked"), F.col("v").alias("q"), "dim"), "asked").join(classes.select("cid", F.col("v").alias("near")), "cid").collect()
    plan = {}
    for dim, n in sizes.items():
        asked: dict[int, tuple[list, list]] = {}
        for r in pairs:
            if r["dim"] == dim:
                asked.setdefault(r["asked"], (r["q"], []))[1].append(r["near"])
        functions = functions_for(n, dim)
        plan[dim] = fit_probes(np.array([q for q, _ in asked.values()]), [np.array(near) for _, near in asked.values()], functions) if asked else (functions, 1)

    queries = rows.where(is_query(F.col("vec_id"))).join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid")
    asks = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v", "dim")
    best = _best(_streamed(index, asks, k + 1, blocks, plan), k + 1).join(classes.select("cid", "ids"), "cid")
    lists = best.groupBy("asked").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))))).alias("near"))
    own = queries.join(lists, queries["cid"] == lists["asked"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _empty(vectors: DataFrame, id_col: str) -> DataFrame:
    ids = pick(vectors, id_col).limit(0).toDF("query_id")
    return ids.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
