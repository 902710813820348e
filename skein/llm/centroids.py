"""Centroid clustering of integer vectors, exact: blocked matrix products in double precision.

Vectors are packed into blocks of integers and written once to the shared
folder. In each round the centroids are broadcast (a few vectors), and every
block computes its squared distances as |x|^2 - 2 x.c + |c|^2 with one matrix
product. Doubles hold integers below 2^53 exactly, whatever the order of
summation, so where the magnitudes of block and centroids bound all terms below
that, the product is exact; beyond it the same sums are made of 64-bit
integers, and beyond 2^63 of Python's. RDD.treeAggregate combines the sums and
counts of the blocks, so that the driver gets a few partial results at any size.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick

#: Vectors of a block, centroids, rounds, and the factor that makes integers of components.
BLOCK, CENTROIDS, ROUNDS, SCALE = 4096, 8, 10, 1024
#: Levels of the tree that combines sums.
DEPTH = 3
#: Bounds below which sums of integers are exact in doubles and in 64 bits.
EXACT_DOUBLE, EXACT_LONG = 2**53, 2**63
PACKED = "ids binary, known binary, kind string, vectors binary"


def scaled(x: float) -> int:
    """floor(SCALE * x) without overflow."""
    return math.floor(x * SCALE) if abs(x) < 2.0**60 else int(x) * SCALE


def as_integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as integers of the least sufficient width, or as objects."""
    top = float(np.abs(x).max(initial=0.0)) * SCALE
    if top >= 2.0**62:
        out = np.empty(x.shape, object)
        out[...] = [[scaled(v) for v in row] for row in x.tolist()]
        return out
    whole = np.floor(x * SCALE)
    return whole.astype(next(t for t, most in ((np.int16, 2**15 - 1), (np.int32, 2**31 - 1), (np.int64, 2**62)) if top < most))


def _magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x (integers) to those of c (integers, as objects):
    doubles, 64-bit integers or objects, as the magnitudes allow."""
    bound = x.shape[1] * (_magnitude(x) + _magnitude(c)) ** 2
    if bound < EXACT_DOUBLE:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    kind = np.int64 if bound < EXACT_LONG else object
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - own) ** 2).sum(axis=1) for own in b], axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of equal ones; its squared distance) of each row."""
    d = squared_distances(x, c)
    number = d.argmin(axis=1)
    return number, np.take_along_axis(d, number[:, None], 1)[:, 0]


def block_sums(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, componentwise sums, summed distances) of the clusters of one block, as Python integers."""
    number, distance = nearest(x, c)
    counts, sums, inertia = np.zeros(len(c), object), np.zeros(c.shape, object), np.zeros(len(c), object)
    wide = object if x.dtype == object or _magnitude(x) * max(1, len(x)) >= EXACT_LONG else np.int64
    far = object if distance.dtype == object or int(distance.max(initial=0)) * max(1, len(x)) >= EXACT_LONG else np.int64
    for k in np.unique(number).tolist():
        own = number == k
        counts[k] = int(own.sum())
        sums[k] = np.array([int(v) for v in x[own].astype(wide).sum(axis=0)], object)
        inertia[k] = int(distance[own].astype(far).sum())
    return counts, sums, inertia


def packed(vectors: DataFrame) -> DataFrame:
    """Vectors (vec_id, embedding) as PACKED blocks of at most BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, values = part.column("vec_id"), part.column("embedding").flatten()
                x = as_integers(values.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                kind = "object" if x.dtype == object else x.dtype.str
                raw = pickle.dumps(x.tolist()) if x.dtype == object else x.tobytes()
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                row = [[ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], [known.tobytes()], [kind], [raw]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.binary(), pa.binary(), pa.string(), pa.binary()))], names=["ids", "known", "kind", "vectors"])

    return vectors.mapInArrow(run, PACKED)


def unpacked(kind: str, vectors: bytes, dims: int) -> np.ndarray:
    if kind == "object":
        return np.array(pickle.loads(vectors), object).reshape(-1, dims)
    return np.frombuffer(vectors, kind).reshape(-1, dims)


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors with exactly dims components, all finite numbers."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is above infinity
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(sound)


def first_centroids(rows: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors whose hashed ids are smallest (equal ids: the smaller vector), as integers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(key, "embedding").limit(k).collect()
    return np.array([[scaled(v) for v in r["embedding"]] for r in chosen], object).reshape(len(chosen), dims)


def _combined(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def totals(blocks, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, summed distances) of all blocks, an RDD of (kind, vectors)."""
    sent, dims = blocks.context.broadcast(c), c.shape[1]
    zero = (np.zeros(len(c), object), np.zeros(c.shape, object), np.zeros(len(c), object))
    found = blocks.treeAggregate(zero, lambda acc, row: _combined(acc, block_sums(unpacked(row[0], bytes(row[1]), dims), sent.value)), _combined, DEPTH)
    sent.unpersist()
    return found


def moved(c: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; those without vectors stay."""
    return np.array([[int(s) // int(n) for s in own] if n else list(old) for old, own, n in zip(c, sums, counts)], object).reshape(c.shape)


def _long(value: int) -> int | None:
    return value if abs(value) < EXACT_LONG else None


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = 64, seed: int = 3) -> DataFrame:
    """Every sound vector of vectors (vec_id, embedding) -> SCHEMA.

    Vectors that are null, of another length than dims, or hold a null or a
    number that is not finite take no part. Components become floor(1024 * x), exactly at
    any magnitude. The k vectors whose sha256 of `seed:vec_id` is smallest begin as
    centroids (fewer, if there are fewer; of equal ids the smaller vector comes first; a null
    id is the empty text). Repeated rows count each; ties go to the smaller centroid number. Distances
    and inertias that no long can hold are null, though decided exactly. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, dims)
    c = first_centroids(rows, k, dims, seed)
    if not len(c):
        return spark.createDataFrame([], SCHEMA)
    table = checkpoint(packed(rows))
    blocks = table.select("kind", "vectors").rdd.map(tuple)
    for _ in range(rounds):
        counts, sums, _ = totals(blocks, c)
        c = moved(c, counts, sums)
    each = [int(v) for v in totals(blocks, c)[2]]
    prints = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in c]
    whole, final = _long(sum(each)), [_long(v) for v in each]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number, distance = nearest(unpacked(row["kind"], row["vectors"], dims), c)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
                at, n = number.tolist(), len(number)
                columns = [
                    ids, pa.array(number.astype(np.int32)), pa.array([_long(int(v)) for v in distance], pa.int64()),
                    pa.array([final[j] for j in at], pa.int64()), pa.array([whole] * n, pa.int64()), pa.array([prints[j] for j in at], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return table.mapInArrow(assigned, SCHEMA)


def _rounds_sql() -> str:
    """Assignment and means, once for each round, and the last assignment."""
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"""d{r} as materialized (select v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from parts v join c{r} c using (j) group by v.vec_id, c.k),
a{r} as materialized (select vec_id, arg_min(k, d * 8 + k) as k, min(d) as d from d{r} group by vec_id)""")
        if r < ROUNDS:
            parts.append(f"""m{r} as (select a.k, v.j, sum(v.x) as s, count(*) as n from parts v join a{r} a using (vec_id) group by a.k, v.j),
c{r + 1} as materialized (select c.k, c.j, case when m.n is null then c.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as x from c{r} c left join m{r} m using (k, j))""")
    return ",\n".join(parts)


#: For a table whose ids differ.
CLUSTER_SQL = f"""with kept as (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = 64),
parts as materialized (select vec_id, j, cast(floor(1024 * cast(embedding[j] as double)) as hugeint) as x from kept, range(1, 65) t(j)),
chosen as (select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as k from kept qualify k < {CENTROIDS}),
c0 as materialized (select k, j, x from chosen join parts using (vec_id)),
{_rounds_sql()},
prints as (select k, sha256(string_agg(cast(x as varchar), ',' order by j)) as centroid_sha256 from c{ROUNDS} group by k),
sums as (select k, sum(d) as own from a{ROUNDS} group by k)
select vec_id, cast(k as int) as cluster, cast(d as bigint) as distance, cast(own as bigint) as cluster_inertia, cast((select sum(d) from a{ROUNDS}) as bigint) as inertia, centroid_sha256
from a{ROUNDS} join sums using (k) join prints using (k)"""
