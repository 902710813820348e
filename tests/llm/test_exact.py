"""Centroid clustering, sharding and fill-in-the-middle: brute force, round trips and DuckDB."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import centroids, fill_in_middle, queries, sharding

# ---- all three


@pytest.mark.parametrize("name", ["op11_centroids", "op12_sharding", "op13_fill_in_middle"])
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = db.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.project(", ".join(names)).fetchall()))


# ---- centroids


def clustered(rows, k, rounds, dims, seed=3):
    """[(vec_id, cluster, distance)] by the definition, in Python's integers."""
    ok = [(i, [math.floor(float(v) * 1024) if abs(v) < 1e15 else int(v) * 1024 for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    sha = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, x in sorted(ok, key=lambda r: (sha(r[0]), r[1]))[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for r in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for _, x in ok]
        if r < rounds:
            own = [[x for (_, x), a in zip(ok, at) if a == j] for j in range(len(c))]
            c = [[sum(col) // len(o) for col in zip(*o)] if o else old for o, old in zip(own, c)]
    return sorted(((i, a, far(x, c[a])) for (i, x), a in zip(ok, at)), key=str), c


@pytest.mark.parametrize("size", [1.0, 3e4, 1e7, 1e30])
def test_clusters_at_all_magnitudes(spark, monkeypatch, size):
    """Doubles, 64-bit integers and Python's give the same, exactly."""
    monkeypatch.setattr(centroids, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * size).tolist()) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (200, None), (201, [1.0] * 5), (202, [1.0] * 5 + [None]), (203, [1.0] * 5 + [float("nan")]), (204, [float("-inf")] * 6), (205, [0.0] * 6)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, Embedding string, cluster int")
    got = centroids.cluster(table, k=4, rounds=5, dims=6)
    want, c = clustered(rows, 4, 5, 6)
    held = lambda v: v if v < 2**63 else None
    out = got.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=str) == sorted(((i, a, held(d)) for i, a, d in want), key=str)
    each = [sum(d for _, a, d in want if a == j) for j in range(4)]
    prints = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    assert {(r.cluster, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out} == {(a, held(each[a]), held(sum(each)), prints[a]) for _, a, _ in want}
    assert got.columns == [f.split()[0] for f in centroids.SCHEMA.split(", ")]


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    table = spark.createDataFrame([(i % 2, [0.5, -0.5]) for i in range(50)], schema)
    got = centroids.cluster(table, k=8, rounds=2, dims=2).collect()
    assert len(got) == 50 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}  # ties go to the first
    assert centroids.cluster(table.limit(0), dims=2).collect() == [] and centroids.cluster(table, dims=3).collect() == []


def test_which_arithmetic_is_used():
    x = np.array([[3, -4]], np.int64)
    assert centroids.squared_distances(x, np.array([[0, 0]], object)).dtype == np.float64
    assert centroids.squared_distances(x * 2**28, np.array([[0, 0]], object)).dtype == np.int64
    d = centroids.squared_distances(x.astype(object) * 2**40, np.array([[0, 0]], object))
    assert d.dtype == object and d[0, 0] == 25 * 2**80
    edge = np.array([[2**25, 2**25 - 1]], np.int64)  # just under and over the bound of doubles
    assert int(centroids.squared_distances(edge, np.array([[-(2**25), 1]], object))[0, 0]) == (2**26) ** 2 + (2**25 - 2) ** 2
    assert [str(centroids.as_integers(np.array([[v]])).dtype) for v in (31.9, 1e3, 1e9, 1e300)] == ["int16", "int32", "int64", "object"]
    assert centroids.scaled(1.5e300) == int(1.5e300) * 1024 and centroids.scaled(-0.0001) == -1


def test_hot_vector_goes_through_few_values(spark):
    """A block's sums are a few integers, whatever repeats; the tree combines them."""
    table = spark.range(0, 20_000, 1, 16).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(-1.0), F.col("id") % 5 * 1.0)).alias("embedding"))
    got = centroids.cluster(table, k=3, rounds=3, dims=2).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in got) == 20_000


# ---- sharding


def drawn(key, name, weight):
    u = (int(hashlib.md5(f"{key}@{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight if weight else math.inf


def descended(tree, key):
    g = min(range(len(tree.regions)), key=lambda g: drawn(key, f"g{g}", sum(w for rack in tree.regions[g] for _, w in rack)))
    r = min(range(len(tree.regions[g])), key=lambda r: drawn(key, f"r{g}.{r}", sum(w for _, w in tree.regions[g][r])))
    return min(tree.regions[g][r], key=lambda leaf: drawn(key, f"s{leaf[0]}", leaf[1]))[0]


def shards_of(spark, tree, n=6000):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("SHARD"))
    return {r["doc_id"]: r["shard"] for r in sharding.assign(rows, tree).collect()}


def test_descent_shares_and_movement(spark):
    tree = sharding.Tree.even(40)
    before = shards_of(spark, tree)
    assert all(before[k] == descended(tree, k) for k in range(0, 6000, 7))
    assert set(before.values()) == set(range(40)) and max(Counter(before.values()).values()) < 210
    after = shards_of(spark, tree.grown())  # one more shard takes rows only into itself
    moved = [k for k in before if before[k] != after[k]]
    assert 90 < len(moved) < 210 and {after[k] for k in moved} == {40}
    twice = shards_of(spark, tree.grown().grown(2.0))
    assert {twice[k] for k in after if after[k] != twice[k]} == {41}
    heavier = shards_of(spark, tree.reweighted(7, 3.0))  # region 0, rack 1
    for k in (k for k in before if before[k] != heavier[k]):
        assert heavier[k] < 20  # into the region that grew, or within it
        assert before[k] >= 20 or 5 <= heavier[k] < 10  # within it: into the rack that grew
        assert not (5 <= before[k] < 10) or heavier[k] == 7  # within that: into the shard that grew
    without = shards_of(spark, tree.reweighted(7, 0.0))
    assert 7 not in without.values() and Counter(heavier.values())[7] > 2 * Counter(before.values())[7]
    with pytest.raises(ValueError):
        shards_of(spark, sharding.Tree.even(1).reweighted(0, 0.0))
    assert set(shards_of(spark, sharding.Tree.even(1), 20).values()) == {0}


def test_slots_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, None), (None, "a"), (1, None), (1, ""), (2, "é😀"), (3, "w " * 300_000)] + [(4, "same")] * 100 + [(i, "t") for i in range(10, 150)]
    table = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], "doc_id long, text string, Text string, slot int, shard int")
    got = sharding.shard_documents(table).collect()
    expect = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expect
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    tree = sharding.Tree.even(40)
    for r in got:
        key = "" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard, r.law) == (descended(tree, key), descended(tree.grown(), key), "key")
    place = lambda r: (int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}#{r['size']}#{r.text_crc32}".encode()).hexdigest()[:12], 16))
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert all(a.shard != b.shard or place(a) <= place(b) for a, b in zip(in_order, in_order[1:]))
    assert sharding.shard_documents(table.limit(0)).count() == 0
    wide = sharding.assign(table, tree)
    assert sorted(wide.columns) == ["Text", "doc_id", "shard", "slot", "text"] and wide.count() == len(rows)


def test_written_shards(spark, tmp_path):
    table = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.Tree.even(8, racks=2, rack_shards=2)
    sharding.write_shards(table, str(tmp_path / "out"), tree, files=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 400 and all(r.shard == descended(tree, r.doc_id) for r in back)


def test_sharding_is_native_and_reads_texts_once(spark, sf_dir):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # generated code that grows too large would raise
    try:
        made = queries.op12_sharding(spark, sf_dir)
        assert made.collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|ExistingRDD|CartesianProduct|NestedLoop", plan) and "ReusedExchange" in plan.split("Initial Plan")[0]


# ---- fill in the middle


def test_ropes_split_and_join():
    rng = np.random.default_rng(2)
    for unit in (None, re.compile(r"\S+"), re.compile(r"\n")):
        text = "".join(rng.choice(list("ab cé😀\n "), 60_000).tolist())
        whole = fill_in_middle.rope(text, unit)
        starts = list(range(len(text))) if unit is None else [0, *[m.start() for m in unit.finditer(text)][1:]]
        assert (whole.units, whole.chars) == (len(starts), len(text)) and whole.height < 10
        for rank in [0, 1, whole.units, whole.units - 1, *map(int, rng.integers(0, whole.units, 40))]:
            a, b = fill_in_middle.split(whole, rank, unit)
            at = starts[rank] if rank < len(starts) else len(text)
            assert fill_in_middle.text_of(a) == text[:at] and fill_in_middle.text_of(b) == text[at:]
            assert (a.units if a else 0) == rank and (b.units if b else 0) == len(starts) - rank
            back = fill_in_middle.join(b, a)
            assert fill_in_middle.text_of(back) == text[at:] + text[:at] and back.height < 16
        for chars in map(int, rng.integers(0, len(text), 20)):
            a, b = fill_in_middle.split(whole, chars, unit, chars=True)
            assert (fill_in_middle.text_of(a), fill_in_middle.text_of(b)) == (text[:chars], text[chars:])
    node = None
    for k in range(3000):  # one leaf at a time stays balanced
        node = fill_in_middle.join(node, fill_in_middle.leaf(str(k % 10), 1))
    assert node.height < 20 and node.units == 3000 and fill_in_middle.rope("", None) is None
    assert fill_in_middle.rope("no unit", re.compile("x")).units == 0


def test_sentinels_over_leaves(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "LEAF", 2)
    for text in ("", "<", "<<PS>>", "<P<S<M" * 3, ">" * 9, "abc<P\n>é😀"):
        for a in range(len(text) + 1):
            for b in range(len(text) + 1):
                for form, shape in (("psm", "<P>{0}<S>{2}<M>{1}"), ("spm", "<S>{2}<P>{0}<M>{1}")):
                    out, prefix, middle = fill_in_middle.rearranged(text, a, b, form)
                    lo, hi = min(a, b), max(a, b)
                    assert out == shape.format(text[:lo], text[lo:hi], text[hi:]) and (prefix, middle) == (lo, hi - lo)
                    assert fill_in_middle.restored(out, form) == text
    assert fill_in_middle.restored("<P>a<S>", "plain") == "<P>a<S>"


def test_documents_by_code_point_and_by_word(spark):
    rows = [(i, f"word{i} é😀 two\nthree " * (i % 40)) for i in range(300)] + [(None, "null id"), (900, None), (901, ""), (902, "has <M> in it"), (903, "x" * 2_000_000), (7, "again"), (7, "again")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, N int, Text string")
    got = fill_in_middle.digests(table).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        text, h = t or "", sha(f"1:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        if not text or "<M>" in text or h3 % 100 >= 90:
            want.append((i, len(text), "plain", None, None, sha(text), sha(text)))
        else:
            form = "spm" if h4 % 100 < 20 else "psm"
            p, m, s = text[:a], text[a:b], text[b:]
            want.append((i, len(text), form, a, b - a, sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)))
    assert Counter(map(tuple, got)) == Counter(want) and {w[2] for w in want} == {"plain", "psm", "spm"}
    words = fill_in_middle.transform_documents(table, seed=4, unit=r"\S+")
    assert words.columns == ["doc_id", "text", "Text", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in words.withColumn("back", fill_in_middle.restorer()("output", "form")).collect():
        assert r.back == (r.text or "") and r.n == len((r.text or "").split())
        if r.form != "plain":  # cuts are where words begin
            ends = {0, len(r.text), *(m.start() for m in re.finditer(r"\S+", r.text))}
            assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends
    assert fill_in_middle.digests(table.limit(0)).count() == 0
