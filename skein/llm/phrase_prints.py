"""Document fingerprints by locally consistent parsing.

A text's code points are its first symbols. On each level, runs of one symbol
become one, deterministic coin tossing turns each symbol into one of six
labels that differs from its neighbour's, a phrase starts where the label is a
local maximum, and the hash of a phrase's symbols names it for the next level.
Where a phrase starts depends on a few symbols around it, so that equal
substrings get the same names inside, wherever they stand.

The fingerprint keeps, for each of BINS classes of names, the least 16-bit
value of the names from level FIRST_LEVEL up (4 hex digits a class, 0000 where
none fell); likeness is the share of equal classes among those that either has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, pick, row_pieces

BINS = 64
FIRST_LEVEL = 2
#: Code points parsed at once (one longer text is parsed alone).
STEP_POINTS = 150_000
#: Ranges of ids for each shuffle partition, so that hashing them evens out.
RANGES_A_PARTITION = 4

_LOWEST = np.array([8, *((k & -k).bit_length() - 1 for k in range(1, 256))], np.uint8)


#: Well-mixed names of the code points of the basic plane.
_NAMES = mix(np.arange(1, 65537, dtype=np.uint64))
#: Odd multipliers for the places in a phrase (a phrase has some ten symbols at most).
_PLACES = mix(np.arange(1 << 20, (1 << 20) + 64, dtype=np.uint64)) | np.uint64(1)


def _labels(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Six-valued labels; neighbours within a text get different ones. start: first symbols of texts."""
    one = x.dtype.type(1)
    d = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=d[1:])
    d[start] = x[start] | (one << x.dtype.type(8 * x.itemsize - 1))
    low = np.bitwise_count((d & -d) - one)
    label = ((x >> low) & one).astype(np.uint8) | (low << 1)  # below 128
    for _ in range(3):  # below 14, 8 and 6
        e = np.empty_like(label)
        np.bitwise_xor(label[1:], label[:-1], out=e[1:])
        e[start] = label[start] | 64
        low = _LOWEST[e]
        label = ((label >> low) & 1) | (low << 1)
        label[start] &= 1
    return label


def _level(x: np.ndarray, doc: np.ndarray, points: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases over the symbols x of the texts doc (sorted), and the phrases' texts.
    points: what the labels are made from, if not from the names."""
    labelled = x if points is None else points
    first = np.empty(len(x), bool)
    first[0] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    new = labelled[1:] != labelled[:-1]
    new |= first[1:]
    if not new.all():
        at = np.r_[0, np.flatnonzero(new) + 1]
        length = np.diff(at, append=len(x))
        x, doc, first, labelled = x[at], doc[at], first[at], labelled[at]
        many = np.flatnonzero(length > 1)
        x[many] = mix(x[many] + length[many].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        labelled = x if points is None else labelled
    label = _labels(labelled, np.flatnonzero(first))
    begin = first.copy()
    if len(x) > 2:
        up = label[1:] > label[:-1]
        begin[1:-1] |= up[:-1] & ~up[1:] & ~first[2:]
    at = np.flatnonzero(begin)
    place = np.arange(len(x), dtype=np.int32) - np.repeat(at.astype(np.int32), np.diff(at, append=len(x)))
    return mix(np.add.reduceat(x * _PLACES[place & 63], at)), doc[at]


def sketches(texts: list[str]) -> np.ndarray:
    """uint16 matrix of the texts' fingerprints, one row each."""
    out = np.full((len(texts), BINS), 0xFFFF, np.uint16)
    sizes = np.array([len(t) for t in texts])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, np.uint32)
    x = _NAMES[points & np.uint32(0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    x[high] = mix(points[high].astype(np.uint64) + np.uint64(1))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    level = 0
    while len(x):
        x, doc = _level(x, doc, points if level == 0 else None)
        level += 1
        alone = np.bincount(doc, minlength=len(texts)) == 1
        last = alone[doc]
        take = slice(None) if level >= FIRST_LEVEL else last
        kept, of = x[take], doc[take]
        value = (kept >> np.uint64(8)).astype(np.uint16) % 0xFFFE + 1
        np.minimum.at(out, (of, (kept % np.uint64(BINS)).astype(np.intp)), value.astype(np.uint16))
        x, doc = x[~last], doc[~last]
    out[out == 0xFFFF] = 0
    return out


def fingerprint_many(texts: list[str]) -> np.ndarray:
    """As sketches, in steps of bounded memory."""
    parts, own, size = [], [], 0
    for t in texts:
        if own and size + len(t) > STEP_POINTS:
            parts.append(sketches(own))
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        parts.append(sketches(own))
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints row by row, 0 to 1; two empty ones are alike."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    both = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def as_hex(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def edited_text(text: str, following: str) -> str:
    """The last half of text (rounded down) gives way to the first as many code points of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, tail: rows dealt by range of doc_id and sorted in it. The first
    document of each range is there once more, marked tail, after the range before it.

    Only ids decide the ranges; their bounds and the first id of each (some a
    shuffle partition) are all that reaches the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * RANGES_A_PARTITION
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("c")).first()["c"]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def ranges(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        return ranges(ids)

    placed = ids.groupBy(place("doc_id").alias("range")).agg(F.min("doc_id").alias("head"))
    heads = sorted((r["range"], r["head"]) for r in placed.collect())
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    @F.arrow_udf("array<struct<range:int,tail:boolean>>")
    def homes(ids: pa.Array) -> pa.Array:
        own = ranges(ids).to_pylist()
        return pa.array(
            [[{"range": r, "tail": False}, {"range": before[i], "tail": True}] if i in before else [{"range": r, "tail": False}] for i, r in zip(ids.to_pylist(), own)],
            pa.list_(pa.struct([("range", pa.int32()), ("tail", pa.bool_())])),
        )

    dealt = docs.select("doc_id", "text", F.inline(homes("doc_id")))
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """Result rows of documents with the texts that follow them and the fingerprints of both."""
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    changed = fingerprint_many(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array(as_hex(own), pa.string()),
            pa.array(as_hex(changed), pa.string()),
            pa.array(likeness(own, changed), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def document_prints(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the one with the next doc_id, after the last the first;
    rows of one id stand in order of text, in one task, for each is the next one's. A row without an id has no place in
    that order and follows itself, as does a single row. A null text counts as
    empty (n_chars 0, all-zero fingerprint, likeness 1 to another empty one); an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, bool]] = []  # the row whose next is not yet known
        print_held = np.zeros((0, BINS), np.uint16)
        for batch in row_pieces(batches, "text"):
            new = [(i, t or "", tail) for i, t, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail")))]
            rows, prints = held + new, np.concatenate([print_held, fingerprint_many([t for _, t, _ in new])])
            held, print_held = rows[-1:], prints[-1:]
            use = [k for k in range(len(rows) - 1) if not rows[k][2]]  # each is followed by a row of its range
            yield _rows([rows[k][0] for k in use], [rows[k][1] for k in use], [rows[k + 1][1] for k in use], prints[use], prints[[k + 1 for k in use]])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = fingerprint_many(texts)
            yield _rows([None] * len(texts), texts, texts, prints, prints)

    bound_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    ordered = _in_order(rows.where("doc_id is not null")).mapInArrow(run, SCHEMA)
    return ordered.unionByName(rows.where("doc_id is null").mapInArrow(alone, SCHEMA))
