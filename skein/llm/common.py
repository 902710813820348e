"""Helpers shared by the operators of this subpackage.

Nothing here holds state between calls except per-worker caches, which are
cleared at a fixed size and when another operator's cache is used in the worker.
"""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's hash cache before it is emptied.
CACHE_WORDS = 150_000
#: Rows of an Arrow batch, which JVM and Python both hold, and Spark's default.
ARROW_ROWS, DEFAULT_ROWS = 500, "10000"
#: Bytes of text that a text function holds as Python strings at once (a longer text is alone).
PIECE_BYTES = 4 << 20
#: Rows of a narrow table that are broadcast at most (some 10 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that a training sample brings to the driver at most, and parts in which it comes; a text
#: that would be more than a part of it teaches nothing, so that no text can take the place of all others.
SAMPLE_BYTES = 64 << 20
SAMPLE_PARTS = 16


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling.

    Extra columns are ignored, also those that differ from a wanted one by
    case alone or repeat its name (the first one counts).
    """
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Give Arrow batches ARROW_ROWS rows where the session has Spark's own default, the same for
    all operators; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) == DEFAULT_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def _cut(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of at most `limit` bytes of text (one value at least). Spark
    bounds the batches themselves by its maxBytesPerBatch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, to - at
        at = to


def pieces(batches: Iterator[pa.Array], limit: int = PIECE_BYTES) -> Iterator[list[str | None]]:
    """The values of string batches as lists of bounded size."""
    for batch in batches:
        for at, n in _cut(batch, limit):
            yield batch.slice(at, n).to_pylist()


def row_pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut to a bounded size of a string column."""
    for batch in batches:
        for at, n in _cut(batch.column(column), limit):
            yield batch.slice(at, n)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder of spark.checkpoint.dir and cut its lineage.

    Without that setting a local session, whose driver is its only executor, gets
    a folder of its own; any other session raises.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="ckpt")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_if_small(small: DataFrame) -> DataFrame:
    """A materialised table, broadcast if its counted rows are few: what it is joined with then stays where it is."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers) over a uint64 array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: The cache that this process used last.
_USED: list[dict] = []


def give_back() -> None:
    """Return what was freed to the system, for the next operator's worker shares an executor's memory with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def use_cache(cache: dict, most: int) -> None:
    """Call before using a cache: at most one of a process holds anything, and at most about `most` entries."""
    if not _USED or _USED[0] is not cache:
        for other in _USED:
            other.clear()
            give_back()
        _USED[:] = [cache]
    if len(cache) > most:
        cache.clear()


class WordHasher:
    """64-bit ids of words, remembered so that each distinct word is hashed once per worker."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        use_cache(seen, CACHE_WORDS)
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            import xxhash

            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


class Sample:
    """Rows (text, label) held as an Arrow table; each pass makes Python values of a few at a time."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __len__(self) -> int:
        return self.table.num_rows

    def release(self) -> None:
        """Give the texts' memory back."""
        self.table = self.table.slice(0, 0)
        pa.default_memory_pool().release_unused()

    def __iter__(self) -> Iterator[tuple[str, object]]:
        for batch in self.table.to_batches(max_chunksize=256):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield text or "", label


def texts_of(docs: DataFrame, chosen: DataFrame, label: str, n: int, limit: int = SAMPLE_BYTES) -> Sample:
    """Rows (text, label) of docs for the chosen ids (doc_id and maybe other columns, few rows), in the
    order of a hash of the id: the first n at most, and no more than hold `limit` bytes of text.
    Texts over a SAMPLE_PARTS-th of that are passed over; if there is nothing else, it raises
    ValueError, for a model of no rows would look like one that has learned.

    Sizes come to the driver first, texts only of the rows that are kept.
    """
    keys = [c for c in chosen.columns if c in docs.columns]
    joined = docs.join(F.broadcast(chosen), keys).withColumn("h", F.xxhash64("doc_id")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    order = ["h", "doc_id", label, "size"]
    short = joined.where(F.col("size") <= limit // SAMPLE_PARTS)
    sizes = short.select(*order).orderBy(*order).limit(n).collect()
    kept = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), limit, side="right")) if sizes else 0
    if not kept:
        if n and joined.limit(1).count():
            raise ValueError(f"all labelled texts have over {limit // SAMPLE_PARTS} bytes: nothing can be learned from them")
        return Sample(pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.string())}))
    edge = sizes[kept - 1]["h"]
    some = short.where(F.col("h") <= edge).repartitionByRange(SAMPLE_PARTS, "h").sortWithinPartitions(*order, "text").select("text", label)
    # part by part, so that the driver's JVM never holds the whole sample
    rows, tables = itertools.islice(some.toLocalIterator(), kept), []
    while part := list(itertools.islice(rows, 256)):
        tables.append(pa.table({"text": pa.array([r[0] for r in part], pa.string()), "label": pa.array([r[1] for r in part])}))
    return Sample(pa.concat_tables(tables))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, n: int) -> Sample:
    """At most n labelled rows outside the held-out fold, as (text, label), in a fixed order.

    The ids come first, from the narrow labels table, in the order of a hash of
    the id; n and SAMPLE_BYTES bound what is broadcast and what reaches the
    driver. Null labels are left out, a null text is empty.
    """
    chosen = pick(labels, "doc_id", label).where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held))
    chosen = chosen.where("doc_id is not null").dropDuplicates().orderBy(F.xxhash64("doc_id"), label).limit(n)
    return texts_of(pick(docs, "doc_id", "text"), chosen, label, n)
