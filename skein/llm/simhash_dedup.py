"""Near-duplicate groups by word shingles, found through SimHash and min-hash bands.

Two documents are linked if the Jaccard likeness of their sets of 5-word
shingles is at least 0.8. Candidates come from the Gray-order SimHash index
and from bands of min-hashes; an exact comparison of the shingle sets confirms
them. The index alone cannot: at a likeness of 0.8 two fingerprints differ in
9 to 10 of 64 bits on average, at which distance unrelated ones begin to be.

1. Equal word sequences form a class; only classes are compared.
2. Each class gets a SimHash fingerprint of its set of shingles and a key of each of
   BANDS bands of min-hashes. Fingerprints within RADIUS bits are candidates.
   The bands' number follows the likeness alone, so a link's chance to be found
   does not fall as the table grows.
3. Classes of one key are candidates unless the sizes of their sets, or 64
   parity bits of them, rule a link out.
4. The components of the candidates are cells; a cell's texts meet once, and a
   search over the documents not yet linked gives the exact links' forest.

A cell of more than CELL_PART classes or PART_SHINGLES shingles is cut into parts, to each of which the
cell's leaders are added: most members of a group of copies are linked through
them. What is then outside of the cell's largest group meets every part of it, or,
in a cell of more than KEYED_PARTS parts, the classes with which it shares a key
or that candidates of the SimHash index join it with: the same candidates, met
key by key. A key of more than GROUP_PART classes gives each of them one edge, to the
first class of like size, and edges between sizes that may link, so that it costs
what its rows cost. No candidate is lost, and no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordHasher, bound_batches, broadcast_if_small, checkpoint, mix, pick, pieces
from .components import connected_components
from .simhash_index import links as near_fingerprints

SHINGLE, SIMILARITY = 5, (4, 5)  # at least 4/5
#: Bands, and min-hashes in each: a pair of likeness s shares no key with probability
#: (1 - s**BAND)**BANDS, 1.2e-7 at 0.8, whatever the number of rows.
BANDS, BAND = 40, 5
#: Bits in which the fingerprints of candidates of the SimHash index differ at most.
RADIUS = 3
#: Members of a key that are compared in one task, classes and shingles of a part of a cell, about, and leaders of a cell.
GROUP_PART, CELL_PART, PART_SHINGLES, LEADERS = 20_000, 500, 2_000_000, 8
#: Parts of a cell beyond which its rest meets by key and not by part: a row has as many keys.
KEYED_PARTS = BANDS
#: Groups whose pairs a task holds at once.
GROUPS = 1_000
#: Most members of a group whose pairs are compared one by one.
SMALL = 16
_HASH = WordHasher()
_FACTORS, _TERMS = np.random.default_rng(31).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.array([[1], [0]], np.uint64)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit names of a text's k-word shingles (A-Z lower-cased, words
    between ASCII white space; fewer words: the whole sequence; none: empty)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    h = _HASH(_ascii_words(words))
    if not len(h):
        return h
    k = min(k, len(h))
    name = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        name = mix(name + h[i : len(h) - k + 1 + i] + np.uint64(i))
    return np.unique(name)


def _ascii_words(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def class_of(text: str | None) -> bytes:
    """The name of a text's word sequence."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 5)


def sketch(text: str | None) -> tuple[bytes, int, int, int, list[int]]:
    """(class key, size of the shingle set, parity bits, SimHash of the set, band keys) of a text."""
    names = shingle_set(text)
    odd = np.bincount((mix(names) >> np.uint64(58)).astype(np.intp), minlength=64) & 1
    return class_of(text), len(names), sum(1 << k for k in np.flatnonzero(odd).tolist()), set_fingerprint(names), band_keys(names)


def set_fingerprint(names: np.ndarray) -> int:
    """SimHash of a set of 64-bit names: the bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(names), 65536):
        ones += np.unpackbits(names[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(names)).tobytes(), "big")


def band_keys(names: np.ndarray) -> list[int]:
    """A key of each band of min-hashes of a set; none of the empty set."""
    if not len(names):
        return []
    least = np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(names), 2048):
        least = np.minimum(least, (names[at : at + 2048, None] * _FACTORS + _TERMS).min(axis=0))
    least = least.reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key + least[:, k])
    return key.tolist()


def _may_link(size_a: np.ndarray, parity_a: np.ndarray, size_b: np.ndarray, parity_b: np.ndarray) -> np.ndarray:
    """False only of pairs that cannot reach SIMILARITY: by the sizes of the sets, or as each
    place where the parities differ holds a shingle that one set lacks."""
    part, whole = SIMILARITY
    lacking = np.bitwise_count(parity_a ^ parity_b).astype(np.int64)
    near = whole * np.minimum(size_a, size_b) >= part * np.maximum(size_a, size_b)
    return near & ((part + whole) * lacking <= (whole - part) * (size_a + size_b))


def set_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets whose Jaccard likeness reaches SIMILARITY, exact:
    each reached set is compared with all that are not yet reached. Two empty sets are alike."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    out: list[tuple[int, int]] = []
    empty = np.flatnonzero(size == 0)
    out += [(int(empty[0]), int(e)) for e in empty[1:]]
    alive = np.flatnonzero(size > 0)
    if len(alive) < 2:
        return out
    names, flat = np.unique(np.concatenate([sets[k] for k in alive]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size[alive])])
    rows = {int(k): flat[starts[i] : starts[i + 1]] for i, k in enumerate(alive)}
    mark = np.zeros(len(names), bool)
    free = np.zeros(n, bool)
    free[alive] = True
    packed = alive
    ids, at = flat, starts[:-1]
    for start in alive.tolist():
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        while queue:
            if np.count_nonzero(free[packed]) * 2 < len(packed):
                packed = packed[free[packed]]
                if not len(packed):
                    return out
                ids = np.concatenate([rows[int(k)] for k in packed])
                at = np.concatenate([[0], np.cumsum(size[packed])[:-1]])
            a = queue.pop()
            mark[rows[a]] = True
            common = np.add.reduceat(mark[ids], at, dtype=np.int64)
            mark[rows[a]] = False
            union = size[a] + size[packed] - common
            for m in packed[(common * SIMILARITY[1] >= SIMILARITY[0] * union) & free[packed]].tolist():
                free[m] = False
                out.append((a, m))
                queue.append(m)
    return out


def _stars(hot: DataFrame) -> DataFrame:
    """hot (node, size, key): the rows of keys with very many classes -> (u, v): edges whose components hold
    all links of each key. Sizes fall into steps of the ratio that a link allows: classes
    of one step may link and are joined with the first of them, steps of which the sizes may
    link by their first ones. An edge a row, by a partial aggregation."""
    ratio = SIMILARITY[1] / SIMILARITY[0]
    stepped = hot.withColumn("step", F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(ratio)))).otherwise(-9))
    first = checkpoint(stepped.groupBy("key", "step").agg(F.min("node").alias("v")))
    own = stepped.join(broadcast_if_small(first), ["key", "step"]).select(F.col("node").alias("u"), "v")
    before = Window.partitionBy("key").orderBy("step")  # of some tens of steps
    near = first.withColumn("u", F.lag("v").over(before)).withColumn("gap", F.col("step") - F.lag("step").over(before)).where("gap <= 2")
    return own.unionByName(near.select("u", "v"))


def _candidates(classes: DataFrame) -> DataFrame:
    """classes (node, size, parity, keys) -> (u, v): edges whose components hold all links of each
    group. Small groups give each pair that may link; others a chain by size, broken where the
    sizes are too far apart for a link across."""

    @F.arrow_udf("array<struct<u:long,v:long>>")
    def search(groups: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in (whole.slice(at, GROUPS) for whole in groups for at in range(0, len(whole), GROUPS)):
            flat = batch.flatten()
            node, size, parity = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "parity"))
            parity = parity.view(np.uint64)
            length = np.array(batch.value_lengths())
            at = np.concatenate([[0], np.cumsum(length)])
            us, vs, owner = [], [], []
            for m in np.unique(length[length <= SMALL]):  # small groups of a size together
                own = np.flatnonzero(length == m)
                i, j = np.triu_indices(m, 1)
                a, b = (at[own][:, None] + i).ravel(), (at[own][:, None] + j).ravel()
                near = _may_link(size[a], parity[a], size[b], parity[b])
                us.append(a[near])
                vs.append(b[near])
                owner.append(np.repeat(own, len(i))[near])
            for g in np.flatnonzero(length > SMALL):
                order = at[g] + np.argsort(size[at[g] : at[g + 1]], kind="stable")
                near = SIMILARITY[1] * size[order[:-1]] >= SIMILARITY[0] * size[order[1:]]
                us.append(order[:-1][near])
                vs.append(order[1:][near])
                owner.append(np.full(len(us[-1]), g))
            u, v, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs, owner))
            order = np.argsort(owner, kind="stable")
            links = pa.StructArray.from_arrays([pa.array(node[u[order]]), pa.array(node[v[order]])], names=["u", "v"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner.astype(np.intp), minlength=len(length)))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)

    keyed = classes.select("node", "size", "parity", F.explode("keys").alias("key"))
    big = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PART).select("key"))
    crowded = not big.isEmpty()
    some = keyed.join(broadcast_if_small(big), "key", "left_anti") if crowded else keyed
    groups = some.groupBy("key").agg(F.collect_list(F.struct("node", "size", "parity")).alias("g")).where(F.size("g") > 1)
    found = groups.select(F.inline(search("g")))
    if crowded:
        found = found.unionByName(_stars(keyed.join(broadcast_if_small(big), "key", "left_semi").select("node", "size", "key")))
    return found.where("u <> v").distinct()


def _same_fingerprints(classes: DataFrame) -> DataFrame:
    """classes (node, fp) -> (u, v): candidates by the SimHash index, equal fingerprints included."""
    first = checkpoint(classes.groupBy("fp").agg(F.min("node").alias("node")))
    equal = classes.join(first.withColumnRenamed("node", "v"), "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    found = near_fingerprints(first.select("fp"), RADIUS)
    ends = found.join(first.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    return equal.unionByName(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _linked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts (doc_id, text), rows (same, doc_id, cell, low, high) -> (u, v): forest of the exact
    links among the rows of each (cell, low, high)."""

    def link(group: pa.Table) -> pa.Table:
        # an id that repeats with other texts brings those too
        text = {s: t for s, t in zip(group.column("same").to_pylist(), group.column("text").to_pylist()) if class_of(t) == s}
        same = list(text)
        found = set_forest([shingle_set(text[s]) for s in same])
        return pa.table({"u": pa.array([same[a] for a, _ in found], pa.binary()), "v": pa.array([same[b] for _, b in found], pa.binary())})

    rows = checkpoint(rows.select("same", "doc_id", "cell", "low", "high"))
    # where few documents meet, the texts of the others stay where they are
    few = checkpoint(rows.select("doc_id").distinct())
    if few.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(few), "doc_id", "left_semi")
    return rows.join(texts, "doc_id").groupBy("cell", "low", "high").applyInArrow(link, "u binary, v binary")


def _parts(n: Column, shingles: Column) -> Column:
    """Of how many parts a cell of n classes with so many shingles is."""
    return F.ceil(F.greatest(n / CELL_PART, shingles / PART_SHINGLES)).cast("int")


def _groups(texts: DataFrame, cells: DataFrame, keys: Callable[[], DataFrame]) -> DataFrame:
    """texts (doc_id, text), cells (same, doc_id, size, cell), keys, called where it is needed, (same, key)
    -> (node, root): the exact links' groups."""
    parts = cells.groupBy("cell").agg(_parts(F.count("*"), F.sum("size")).alias("parts"))
    # tables of a row for each large cell: sent where the rows are, so that no cell meets in one task
    large = checkpoint(parts.where("parts > 1"))
    big = broadcast_if_small(large)
    cut = cells.join(big, "cell", "left").withColumn("low", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("same"), F.col("parts"))).otherwise(0).cast("int"))
    cut = cut.select("same", "doc_id", "cell", "low", F.lit(-1).alias("high"))
    slot = F.pmod(F.xxhash64("same", F.lit(1)), F.lit(LEADERS))
    first = cells.join(big, "cell").groupBy("cell", slot).agg(F.min(F.struct("same", "doc_id")).alias("x"), F.first("parts").alias("parts"))
    leaders = first.select("x.same", "x.doc_id", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("low"), F.lit(-1).alias("high"))
    links = checkpoint(_linked(texts, cut.unionByName(leaders)))
    groups = checkpoint(connected_components(links))
    if large.isEmpty():
        return groups
    # of the large cells: what is not in the largest group meets whatever it may link to
    placed = cells.join(big, "cell").join(groups.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    most = placed.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most"))
    most = broadcast_if_small(checkpoint(most.select("cell", F.col("most.root").alias("largest"))))
    members = checkpoint(placed.join(most, "cell").select("same", "doc_id", "size", "cell", "parts", (F.col("root") != F.col("largest")).alias("rest")))
    meet = members.where(F.col("parts") <= KEYED_PARTS).select("same", "doc_id", "size", "cell", "rest")
    crowd = members.where(F.col("parts") > KEYED_PARTS)
    if not crowd.isEmpty():
        meet = meet.unionByName(crowd.join(keys(), "same").select("same", "doc_id", "size", F.col("key").alias("cell"), "rest"))
    return connected_components(links.unionByName(_linked(texts, _meetings(meet))))


def _meetings(members: DataFrame) -> DataFrame:
    """members (same, doc_id, size, cell, rest) -> same, doc_id, cell, low, high: every part of a cell's rest with every part of the cell."""
    of_rest = F.sum(F.when(F.col("rest"), F.col("size")))
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.count_if("rest").alias("r"), of_rest.alias("q")).where("r > 0 and n > 1")
    sizes = sizes.select("cell", _parts(F.col("n"), F.col("s")).alias("parts"), _parts(F.col("r"), F.col("q")).alias("rests"))
    rows = members.join(broadcast_if_small(checkpoint(sizes)), "cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = rows.where("rest").select("same", "doc_id", "cell", each("parts").alias("low"), F.pmod(F.xxhash64("same"), F.col("rests")).cast("int").alias("high"))
    own = rows.select("same", "doc_id", "cell", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int").alias("low"), each("rests").alias("high"))
    return asks.unionByName(own)


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id of every row of docs (doc_id, text) with an id: group_id is the smallest
    doc_id of the documents that links reach.

    A null text counts as empty; empty texts are equal. Rows without an id take no
    part; repeated rows stay repeated; an empty table gives an empty result; other
    columns are ignored.
    """
    return _grouped(docs).select("doc_id", "group_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicate_groups with the class of each row, same, and the name of its group, root."""
    bound_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text").where("doc_id is not null")

    @F.arrow_udf("struct<same:binary,size:long,parity:long,fp:long,keys:array<long>>")
    def sketched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in pieces(texts):
            got = [sketch(t) for t in piece]
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            keys = pa.array(signed([k for *_, ks in got for k in ks]))
            ends = np.cumsum([0, *(len(ks) for *_, ks in got)])
            yield pa.StructArray.from_arrays(
                [pa.array([s for s, *_ in got], pa.binary()), pa.array([n for _, n, *_ in got], pa.int64()), pa.array(signed([p for _, _, p, *_ in got])), pa.array(signed([f for *_, f, _ in got])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)],
                names=["same", "size", "parity", "fp", "keys"],
            )

    rows = checkpoint(own.select("doc_id", sketched("text").alias("s")).select("doc_id", "s.*"))
    node = F.xxhash64("same")
    named = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = checkpoint(named.withColumn("node", node))
    # the empty set has no bands, and is alone in its class
    prints = checkpoint(_same_fingerprints(classes.where("size > 0").select("node", "fp")))
    cells = connected_components(_candidates(classes).unionByName(prints)).withColumnRenamed("root", "cell")
    placed = checkpoint(classes.select("same", "doc_id", "size", "node").join(cells, "node").select("same", "doc_id", "size", "cell"))

    def keys() -> DataFrame:
        """The bands' keys, and one for each component of the SimHash index's candidates."""
        joined = classes.select("same", "node").join(connected_components(prints), "node")
        return classes.select("same", F.explode("keys").alias("key")).unionByName(joined.select("same", F.xxhash64(F.lit("print"), "root").alias("key")))

    groups = _groups(own, placed, keys).withColumnRenamed("node", "same")
    grouped = classes.select("same", "doc_id").join(groups, "same", "left").withColumn("root", F.coalesce("root", "same"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return rows.select("doc_id", "same").join(grouped.join(least, "root").select("same", "root", "group_id"), "same")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which each near-duplicate group keeps one: that with
    the smallest doc_id (one of them, if the id repeats; texts of one id that are no near
    duplicates are in groups of their own). Rows without an id all stay."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rows = checkpoint(_grouped(docs).select("doc_id", "same", "root"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("first"))
    marked = rows.join(first, "root").select("doc_id", "same", (F.struct("doc_id", "same") == F.col("first")).alias("kept"))
    per_id = marked.groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left = plain.join(per_id.where("not kept").select(key), key, "left_anti")
    twice = per_id.where("n > 1 and kept").select(key)
    if not twice.isEmpty():

        @F.arrow_udf("binary")
        def classes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for piece in pieces(texts):
                yield pa.array(list(map(class_of, piece)), pa.binary())

        kept = marked.where("kept").select(F.col("doc_id").alias(key), "same").distinct()
        one = left.join(twice, key, "left_semi").withColumn("same", classes(text)).join(kept, [key, "same"], "left_semi")
        first = Window.partitionBy(key, "same").orderBy(F.xxhash64(*plain.columns), *plain.columns)
        one = one.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        left = left.join(twice, key, "left_anti").unionByName(one.drop("same"))
    return left.select(*plain.columns).toDF(*names)
