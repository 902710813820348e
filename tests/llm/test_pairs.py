"""SimHash components, near-duplicate groups, fingerprints and neighbours against brute force."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import cross_polytope, phrase_prints, simhash_dedup, simhash_index

SCHEMA = "doc_id long, text string"
ODD = [(None, "a b"), (None, None), (7, None), (8, ""), (8, ""), (9, " \t"), (10, "ONE two"), (11, "one TWO"), (12, "word " * 30_000)]


def union(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(n)]


def varied(n=60, seed=3):
    """Texts in families of small edits."""
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n // 6):
        base = [f"w{rng.integers(9999)}" for _ in range(rng.integers(4, 160))]
        for k in range(6):
            own = list(base)
            for _ in range(k * int(rng.integers(0, 3))):
                own[rng.integers(len(own))] = f"x{rng.integers(9999)}"
            out.append((1000 + len(out), " ".join(own)))
    return out


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA + ", Text string, fingerprint int")


@pytest.mark.parametrize("radius, key_rows", [(2, 50_000), (6, 50_000), (2, 2), (3, 3)])
def test_components(spark, monkeypatch, radius, key_rows):
    monkeypatch.setattr(simhash_index, "KEY_ROWS", key_rows)  # 2: keys are refined
    monkeypatch.setattr(simhash_index, "TREE_ROWS", key_rows * 4)
    rows = varied() + ODD
    got = simhash_index.simhash_components(docs(spark, rows), radius=radius).collect()
    fps = [simhash_index.fingerprint(t) for _, t in rows]
    roots = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, f"{fps[k]:016x}", least.get(roots[k])) for k, (i, _) in enumerate(rows)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash_index.simhash_components(docs(spark, rows).limit(0)).count() == 0


def test_fingerprint_is_by_the_word():
    assert simhash_index.fingerprint(None) == simhash_index.fingerprint(" ") == 0
    assert simhash_index.fingerprint("A b") == simhash_index.fingerprint("a\tb\n") != simhash_index.fingerprint("É b")
    assert simhash_index.fingerprint("É x y") != simhash_index.fingerprint("é x y")


def votes(text, k=3):
    """The contract word for word: counted votes of each bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_by_counting(spark):
    for _, t in varied(24, 11) + [(0, ""), (0, "one"), (0, "Two\u00a0words X"), (0, "a b c a b c a b c"), (0, "\x1ca b\x0bc\u2003d e")]:
        assert simhash_index.fingerprint(t) == votes(t)
    # of one shingle the fingerprint is its hash, which Spark computes too
    row = spark.range(1).select(*[F.xxhash64(F.lit(t)).alias(f"h{k}") for k, t in enumerate(["a b c", "single", "é ü ß"])]).first()
    assert [simhash_index.fingerprint(t) for t in ("A b  C", "single", "é\nü ß")] == [h & (2**64 - 1) for h in row]


def test_index_prunes_real_fingerprints():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    fps = np.unique(np.array([simhash_index.fingerprint(t) for t in texts], np.uint64))
    want = []
    for at in range(0, len(fps), 500):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None]) <= 2)
        want += [(a, b) for a, b in zip((i + at).tolist(), j.tolist()) if a < b]
    place = {x: k for k, x in enumerate(fps.tolist())}
    got, compared = [], 0
    for mask in simhash_index.blocks(0, 2):
        index = simhash_index.GrayIndex(fps, mask)
        for i, j in index.links(2):
            got += [(place[a], place[b]) for a, b in zip(index.values[i].tolist(), index.values[j].tolist())]
        compared += index.compared
    assert want and union(len(fps), got) == union(len(fps), want)
    assert 0 < compared < 0.01 * len(fps) ** 2 / 2


def test_blocks_are_refined():
    for radius in (1, 2, 3, 6):
        level = simhash_index.blocks(0, radius)
        assert sum(level) == simhash_index.ALL and len(level) == radius + 1
        for mask in level:
            finer = simhash_index.blocks(mask, radius)
            assert all(m & mask == mask and m != mask for m in finer) and [a for a in finer if bin(a).count("1") > 64] == []


def test_gray_index():
    rng = np.random.default_rng(0)
    v = np.unique((rng.integers(0, 1 << 62, 12, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 30, (12, 4, 60), dtype=np.uint64)).sum(axis=1).astype(np.uint64)).ravel())
    gray = simhash_index.gray_rank(np.arange(64, dtype=np.uint64))
    order = np.argsort(gray)
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))
    index = simhash_index.GrayIndex(v)
    i, j = map(np.concatenate, zip(*index.links(3)))
    d = np.bitwise_count(index.values[:, None] ^ index.values[None])
    links = np.argwhere(np.triu(d <= 3, 1))
    assert union(len(v), zip(i.tolist(), j.tolist())) == union(len(v), links.tolist())
    assert (np.bitwise_count(index.values[i] ^ index.values[j]) <= 3).all()
    near = index.within(index.values[5], 7)
    assert sorted(near.tolist()) == np.flatnonzero(d[5] <= 7).tolist()


def jaccard_roots(rows):
    sets = [set(simhash_dedup.shingle_set(t).tolist()) for _, t in rows]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])


@pytest.mark.parametrize("part, keyed", [(3_000, 40), (4, 40), (4, 0)])
def test_near_duplicate_groups(spark, monkeypatch, part, keyed):
    monkeypatch.setattr(simhash_dedup, "CELL_PART", part)
    monkeypatch.setattr(simhash_dedup, "KEYED_PARTS", keyed)
    monkeypatch.setattr(simhash_dedup, "GROUP_PART", part * 2)
    rows = varied(90, 5) + [r for r in ODD if r[0] is not None]
    got = dict(map(tuple, simhash_dedup.near_duplicate_groups(docs(spark, rows)).collect()))
    roots = jaccard_roots(rows)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[roots[k]] = min(i, least.get(roots[k], i))
    assert got == {i: least[roots[k]] for k, (i, _) in enumerate(rows)}


def test_shingles_bound_parts(spark, monkeypatch):
    """Parts of few shingles: long texts meet in as many more tasks."""
    monkeypatch.setattr(simhash_dedup, "PART_SHINGLES", 300)
    rows = varied(60, 6)
    got = dict(map(tuple, simhash_dedup.near_duplicate_groups(docs(spark, rows)).collect()))
    roots = jaccard_roots(rows)
    assert got == {i: rows[roots[k]][0] for k, (i, _) in enumerate(rows)}


def test_a_key_of_a_million_classes_is_linear(spark):
    """An edge for each class and a few for the sizes, in whose components all sizes that may link are together."""
    hot = spark.range(0, 1_000_000, 1, 8).select(F.col("id").alias("node"), F.when(F.col("id") % 1000 == 0, 90_000 + F.col("id") % 7).otherwise(40 + F.col("id") % 50).alias("size"), F.lit(7).cast("long").alias("key"))
    edges = simhash_dedup._stars(hot)
    assert 1_000_000 <= edges.count() < 1_000_100
    parts = simhash_dedup.connected_components(edges.where("u <> v")).groupBy("root").count().collect()
    assert sorted(r["count"] for r in parts) == [1000, 999_000]


def edited_pairs(n, sizes=(12, 40, 200), seed=21):
    """Pairs of texts whose likeness is 0.8 or little more: the second has a block appended."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**9, sizes[k % len(sizes)])]
        yield " ".join(words), " ".join(words + [f"x{x}" for x in rng.integers(0, 10**9, (len(words) - 4) // 4)])


def test_keys_do_not_depend_on_the_row_count():
    keys = [[set(simhash_dedup.sketch(t)[-1]) for t in pair] for pair in edited_pairs(600)]
    assert all(a & b for a, b in keys)
    shared = np.mean([len(a & b) / simhash_dedup.BANDS for a, b in keys])
    assert 0.29 < shared < 0.40  # 0.8**5 = 0.33, a little more where 0.8 is not met exactly
    alone = [a for a, _ in keys]
    assert not any(alone[k] & alone[k - 1] for k in range(len(alone)))


@pytest.mark.parametrize("small", [16, 1])
def test_links_near_the_limit(spark, monkeypatch, small):
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    rows = [(k, t) for k, t in enumerate(t for pair in edited_pairs(300, seed=23) for t in pair)]
    got = dict(map(tuple, simhash_dedup.near_duplicate_groups(docs(spark, rows)).collect()))
    assert got == {k: k - k % 2 for k, _ in rows}


def test_may_link_drops_no_link():
    rng = np.random.default_rng(24)
    for n in range(1, 160):
        a = rng.integers(0, 1 << 62, n + n // 4, dtype=np.uint64)
        sets = [a[: n + int(rng.integers(0, n // 4 + 1))], a[n // 9 :], a, rng.permutation(a)[:n]]
        size, odd = np.array([len(s) for s in sets]), [np.bincount((simhash_dedup.mix(s) >> np.uint64(58)).astype(int), minlength=64) & 1 for s in sets]
        parity = np.array([sum(1 << k for k in np.flatnonzero(o).tolist()) for o in odd], np.uint64)
        i, j = np.triu_indices(len(sets), 1)
        alike = np.array([5 * len(np.intersect1d(sets[p], sets[q])) >= 4 * len(np.union1d(sets[p], sets[q])) for p, q in zip(i, j)])
        assert simhash_dedup._may_link(size[i], parity[i], size[j], parity[j])[alike].all()


def repeated_lines(n=20, seed=22):
    """Pairs of texts with nearly equal shingle sets, in which a line stands twice and many times."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        words, line = ([f"w{x}" for x in rng.integers(0, 10**9, m)] for m in (100, 8))
        yield " ".join(words + line * 2), " ".join(words + line * (10, 20, 60)[k % 3])


def test_repeated_lines(spark):
    rows = [(k, t) for k, t in enumerate(t for pair in repeated_lines() for t in pair)]
    got = dict(map(tuple, simhash_dedup.near_duplicate_groups(docs(spark, rows)).collect()))
    assert got == {k: k - k % 2 for k, _ in rows}


def test_keep_one(spark):
    rows = varied(30, 8) + ODD
    out = simhash_dedup.keep_one(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "Text", "fingerprint"]
    kept = [r[0] for r in out.collect()]
    known = [r for r in rows if r[0] is not None]
    roots = jaccard_roots(known)
    least = {}
    for k, (i, _) in enumerate(known):
        least[roots[k]] = min(i, least.get(roots[k], i))
    assert sorted(k for k in kept if k is not None) == sorted(set(least.values())) and kept.count(None) == 2
    assert simhash_dedup.keep_one(docs(spark, rows).limit(0)).count() == 0


def test_repeated_ids_of_other_texts(spark):
    a, b = next(edited_pairs(1, (60,), seed=25))
    c, d, e = (" ".join(f"{x}{k}" for k in range(50)) for x in "cde")
    rows = [(1, a), (5, b), (5, c), (5, c), (6, d), (6, e), (7, e), (8, d + " more")]
    out = [tuple(r)[:2] for r in simhash_dedup.keep_one(docs(spark, rows)).collect()]
    assert sorted(out) == sorted([(1, a), (5, c), (6, d), (6, e)])


def test_groups_of_real_documents(spark, sf_dir):
    """All pairs of sf0.01 compared as sets of word tuples."""
    table = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    size = np.array(list(map(len, sets)))
    pairs = [(a, b) for a in range(len(sets)) for b in np.flatnonzero((5 * size[:a] >= 4 * size[a]) & (4 * size[:a] <= 5 * size[a])).tolist() if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = union(len(sets), pairs)
    least = {}
    for k, r in enumerate(rows):
        least[roots[k]] = min(r["doc_id"], least.get(roots[k], r["doc_id"]))
    assert dict(map(tuple, simhash_dedup.near_duplicate_groups(table).collect())) == {r["doc_id"]: least[roots[k]] for k, r in enumerate(rows)}


@pytest.mark.parametrize("keyed, most", [(1000, 4), (0, 45)])
def test_a_large_cell_costs_in_proportion(spark, monkeypatch, keyed, most):
    """Near copies of one text, and some that only a copy links to: all groups, few rows met."""
    monkeypatch.setattr(simhash_dedup, "CELL_PART", 40)
    monkeypatch.setattr(simhash_dedup, "KEYED_PARTS", keyed)
    rng = np.random.default_rng(26)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(2000):
        own = list(base)
        own[int(rng.integers(300))] = f"x{k}"
        rows.append((k, " ".join(own)))
    # a chain: each is within the limit of the one before it, the last ones not of the base
    chain = list(base)
    for k in range(12):
        chain = chain[6:] + [f"c{k}_{i}" for i in range(6)]
        rows.append((5000 + k, " ".join(chain)))
    met = []
    linked = simhash_dedup._linked
    monkeypatch.setattr(simhash_dedup, "_linked", lambda texts, r: (met.append(r.count()), linked(texts, r))[1])
    got = dict(map(tuple, simhash_dedup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert set(got.values()) == {0} and len(got) == 2012
    assert met[0] < 1.3 * 2012 and sum(met) < most * 2012


def test_set_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([np.arange(50) + 1000 * (k % 4), rng.integers(5000, 9000, rng.integers(0, 14))])).astype(np.uint64) for k in range(60)] + [np.zeros(0, np.uint64)] * 2
    alike = lambda a, b: not len(a) and not len(b) or 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    want = [(a, b) for a in range(62) for b in range(a) if alike(sets[a], sets[b])]
    got = simhash_dedup.set_forest(sets)
    assert union(62, got) == union(62, want) and all(alike(sets[a], sets[b]) for a, b in got)


def test_prints_against_model(spark):
    rows = varied(24, 9) + [r for r in ODD if r[0] not in (None, 8)] + [(5, "\U0001f642é漢" * 40), (6, "aaaa" * 9)]
    got = {r["doc_id"]: r for r in phrase_prints.document_prints(docs(spark, rows)).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    prints = phrase_prints.fingerprint_many([t for _, t in rows])
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        p, q = prints[k : k + 1], phrase_prints.fingerprint_many([edited])
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == phrase_prints.as_hex(p)[0] and r["edited_fingerprint"] == phrase_prints.as_hex(q)[0]
        assert r["near_edited"] == pytest.approx(phrase_prints.likeness(p, q)[0])
        assert r["near_next"] == pytest.approx(phrase_prints.likeness(p, prints[[(k + 1) % len(rows)]])[0])


M64 = (1 << 64) - 1


def slow_mix(x):
    x ^= x >> 32
    x = x * 0x9E3779B97F4A7C15 & M64
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 32


def zeros(x, none):
    return (x & -x).bit_length() - 1 if x else none


def slow_level(names, points=None):
    """Names of the next level, symbol by symbol: runs, coin tossing, phrases from local maxima.
    Labels come from the code points on the first level and from the names on the others."""
    runs = []
    for k, name in enumerate(names):
        mark = name if points is None else points[k]
        if runs and runs[-1][1] == mark:
            runs[-1][2] += 1
        else:
            runs.append([name, mark, 1])
    names = [slow_mix(n + k * 0xA24BAED4963EE407 & M64) if k > 1 else n for n, _, k in runs]
    marks = names if points is None else [m for _, m, _ in runs]
    labels, top = [], 63 if points is None else 31
    for k, m in enumerate(marks):
        low = zeros(m ^ marks[k - 1], 64) if k else zeros(m | 1 << top, 64)
        labels.append((m >> low & 1) | low << 1)
    for _ in range(3):
        lows = [zeros(m ^ labels[k - 1], 8) if k else zeros(m | 64, 8) for k, m in enumerate(labels)]
        labels = [(m >> low & 1) | low << 1 for m, low in zip(labels, lows)]
        labels[0] &= 1
    starts = [k for k in range(len(labels)) if k == 0 or (k < len(labels) - 1 and labels[k] > labels[k - 1] and labels[k + 1] <= labels[k])]
    place = [slow_mix((1 << 20) + k) | 1 for k in range(64)]
    return [slow_mix(sum(names[k] * place[k - a & 63] for k in range(a, b)) & M64) for a, b in zip(starts, [*starts[1:], len(names)])]


def slow_print(text):
    """The fingerprint of one text by plain integers."""
    least = [None] * 64
    names, points, level = [slow_mix(ord(c) + 1) for c in text], [ord(c) for c in text], 0
    while names:
        names, points, level = slow_level(names, points), None, level + 1
        if level >= 2 or len(names) == 1:
            for x in names:
                value = ((x >> 8) & 0xFFFF) % 0xFFFE + 1
                least[x % 64] = min(value, least[x % 64] or value)
        if len(names) == 1:
            break
    return "".join(f"{v or 0:04x}" for v in least)


def test_prints_by_plain_integers():
    texts = [t or "" for _, t in varied(18, 12) + ODD[:8]] + ["a", "ab", "aaaaaaa", "abababab", "\U0001f642é漢" * 30, "x" * 500 + "y", "\x00\x00a", "the quick brown fox " * 40]
    assert phrase_prints.as_hex(phrase_prints.fingerprint_many(texts)) == [slow_print(t) for t in texts]


def test_prints_follow_equal_parts():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    a, b, c = (" ".join(word() for _ in range(300)) for _ in range(3))
    p = phrase_prints.fingerprint_many([a, "some words before " + a, a[:900] + b[900:], c])
    like = [phrase_prints.likeness(p[:1], p[k : k + 1])[0] for k in range(4)]
    assert like[0] == 1 and like[1] > 0.85 and 0.15 < like[2] < 0.6 and like[3] < 0.05


def test_prints_of_odd_tables(spark):
    got = phrase_prints.document_prints(docs(spark, [(None, "b"), (None, None), (3, "abc"), (3, "abc"), (1, "")])).collect()
    assert len(got) == 5 and {r["n_chars"] for r in got} == {0, 1, 3}
    alone = phrase_prints.document_prints(docs(spark, [(4, "abcd" * 50)])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert phrase_prints.document_prints(docs(spark, [(4, "x")]).limit(0)).count() == 0


def exact(ids, vectors, query, k):
    d = np.sqrt(((vectors - vectors[ids.index(query)]) ** 2).sum(axis=1))
    return [(i, s) for s, i in sorted((s, i) for s, i in zip(d.tolist(), ids) if i != query)][:k]


def test_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = table.select("vec_id", "embedding").collect()
    ids, vectors = [r[0] for r in data], np.array([r[1] for r in data], float)
    got = cross_polytope.nearest_neighbours(table, lambda i: i % 25 == 0).collect()
    hits = total = 0
    for q in [i for i in ids if i % 25 == 0]:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        want = exact(ids, vectors, q, 10)
        hits += len({i for _, i, _ in own} & {i for i, _ in want})
        total += 10
        for _, i, s in own:
            assert s == pytest.approx(np.sqrt(((vectors[ids.index(i)] - vectors[ids.index(q)]) ** 2).sum()), abs=1e-12)
    assert hits / total >= 0.9


def test_neighbours_in_many_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(cross_polytope, "functions_for", lambda n, dim: 3)
    monkeypatch.setattr(cross_polytope, "BLOCK_BYTES", 30 * 256)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(300)
    data = table.select("vec_id", "embedding").collect()
    ids, vectors = [r[0] for r in data], np.array([r[1] for r in data], float)
    got = cross_polytope.nearest_neighbours(table, lambda i: i % 10 == 0, k=5).collect()
    asked = [i for i in ids if i % 10 == 0]
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for i, _ in exact(ids, vectors, q, 5)}) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)


@pytest.mark.parametrize("groups, share", [(0, 0.1), (500, 0.1)])
def test_recall_and_share_of_fifty_thousand_vectors(groups, share):
    """Recall of 0.9 and more against brute force with few vectors compared: uniform on a sphere of few
    effective dimensions, and clustered."""
    rng = np.random.default_rng(12 + groups)
    vectors = rng.normal(size=(50_001, 64)) * np.linspace(1.6, 0.2, 64)
    if groups:
        vectors = rng.normal(size=(groups, 64))[rng.integers(groups, size=50_001)] + 0.3 * rng.normal(size=(50_001, 64))
    vectors, ids = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32), np.arange(50_001)
    assert len(ids) > 50_000
    functions = cross_polytope.functions_for(len(ids), 64)
    some = np.random.default_rng(8).choice(len(ids), cross_polytope.SAMPLE_QUERIES, False)
    true = list(cross_polytope.nearest_of_all(vectors[some], np.arange(len(ids)), vectors, 11))
    block = cross_polytope.Block(ids, vectors, *cross_polytope.fit_probes(vectors[some], [vectors[i[1:]] for i, _ in true], functions))
    asked = np.flatnonzero(ids % 100 == 0)[::3]
    squares = (vectors.astype(float) ** 2).sum(axis=1)
    hits = 0
    for q, (found, _) in zip(asked, block.search(vectors[asked], 11)):
        d = squares - 2 * (vectors.astype(float) @ vectors[q].astype(float))
        hits += len(set(ids[np.argsort(d)[:11]].tolist()) & set(found.tolist())) - 1
    assert hits >= 0.9 * 10 * len(asked) and block.compared < share * len(asked) * len(ids)


def test_all_buckets_can_be_probed_with_one_function():
    """Over 1,024 components there are more buckets than MOST_PROBES."""
    x = np.random.default_rng(7).normal(size=(3, 1500))
    functions, probes = cross_polytope.fit_probes(x, [-x[:1], x[:2], x[1:]], 1)
    assert functions == 1 and cross_polytope.MOST_PROBES < probes <= 4096


def test_probes_are_the_nearest_buckets():
    x = cross_polytope.unit(np.random.default_rng(9).normal(size=(7, 10)))
    near = [cross_polytope.signed_axes(x, 3, f) for f in range(2)]
    sums = (near[0][:, :, None] + near[1][:, None, :]).reshape(7, -1)
    got = cross_polytope.probed(x, 3, 2, 40)
    assert (np.take_along_axis(sums, got, 1) == -np.sort(-sums, axis=1)[:, :40]).all() and all(len(set(own)) == 40 for own in got.tolist())
    assert (got[:, 0] == cross_polytope.codes_of(x, 3, 2)).all()
    for d in (64, 3):  # the matrix and the fast transform turn alike
        v = cross_polytope.unit(np.random.default_rng(1).normal(size=(5, d)))
        a = cross_polytope.signed_axes(v, 0, 0)
        y = cross_polytope.rotated(v, 0, 0)
        assert np.allclose(a, np.concatenate([y, -y], axis=1), atol=1e-5) and np.allclose((y**2).sum(axis=1), 1, atol=1e-5)


def test_neighbours_of_odd_vectors(spark):
    copies = [(i * 100 if i < 3 else i, [1.0, 0.0, 0.5]) for i in range(30)]
    odd = [(500, None), (600, [0.0, 0.0, 0.0]), (700, [float("nan"), 1.0, 2.0]), (800, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (900, [1.0, None, 0.4]), (1000, [float("inf"), 0.0, 1.0]), (1100, [])]
    rows = spark.createDataFrame([(*r, 7, "x", [1.0]) for r in copies + copies[:2] + odd], "vec_id long, embedding array<float>, query_id int, score string, Embedding array<double>")
    got = cross_polytope.nearest_neighbours(rows, lambda i: i % 100 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200} and len(got) == 30
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert cross_polytope.nearest_neighbours(rows.limit(0), lambda i: i % 100 == 0).count() == 0
