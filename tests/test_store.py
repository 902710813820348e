"""Byte ranges, side tables, layers by several writers, names, impacts, progress and the stream of changes."""

import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from skein.api import Engine
from skein.functions import text
from skein.operators import fts, ingest, search, store
from skein.schema import Filters
from skein.sources import files, fs
from skein.sources.config import Config
from skein.streaming import changes, refresh


def say(session, body, role="user", **more):
    return json.dumps({"sessionId": session, "type": role, "timestamp": "2024-01-01T10:00:00Z", "message": {"role": role, "content": body}, **more})


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))
    return str(path)


def listed(spark, *paths):
    return spark.createDataFrame([files._entry("claude", p) for p in paths], files.LISTED).repartition(2)


# ---- byte ranges


def test_ranges_give_the_rows_of_one_range(spark, tmp_path):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("abc é😀") for _ in range(rng.randrange(30))) for _ in range(40)] + ["long " * 400]
    many = put(tmp_path / "many.jsonl", *(say("s", b) for b in bodies[:20]), "", "not json", *(say("s", b) for b in bodies[20:]))
    open_end = tmp_path / "open.jsonl"
    open_end.write_bytes((say("o", "a") + "\r\n" + say("o", "b é")).encode())
    empty, link = tmp_path / "empty.jsonl", tmp_path / "link.jsonl"
    empty.write_bytes(b"")
    link.symlink_to(many)  # its own size is not that of the file
    bad = tmp_path / "bad.jsonl"
    bad.write_bytes(b"".join(say("b", f"{k}").encode() + b"\n" for k in range(30)) + b'{"x": "\xe2\x82"}\n')
    paths = [many, str(open_end), str(empty), str(link), str(bad), str(tmp_path), str(tmp_path / "gone.jsonl")]
    folds = lambda size: ingest.folded(ingest.messages(ingest.read(listed(spark, *paths), size))).collect()
    rows = lambda size: sorted(str(r if r.error is None else (r.source_path, r.error)) for r in folds(size))
    whole = rows(None)
    for size in (100, 1 << 12):
        assert rows(size) == whole
    got = {r.source_path: r for r in folds(64)}
    assert got[many].line_count == 43 == got[str(link)].line_count and got[str(empty)].line_count == 0 and got[str(open_end)].last_user == "b é"
    assert got[many].message_count == sum(bool(b.strip()) for b in bodies) and got[many].last_user == ("long " * 400).strip()
    with pytest.raises(UnicodeDecodeError) as e:
        bad.read_bytes().decode()
    assert got[str(bad)].error == f"UnicodeDecodeError: {e.value}"  # as if the file were decoded as one
    assert "IsADirectory" in got[str(tmp_path)].error and "FileNotFound" in got[str(tmp_path / "gone.jsonl")].error
    none = spark.createDataFrame([], "id string, title string, cwd string, created_at long, updated_at long, rollout_path string, first_user_message string")
    sessions = ingest.sessions(ingest.read(listed(spark, *paths), 64), none, spark.createDataFrame([], "id string, thread_name string"))
    failed = {r.source_path: r for r in sessions.where("parse_warning is not null").collect()}
    assert set(failed) == {str(bad), str(tmp_path), str(tmp_path / "gone.jsonl")}
    assert all((r.message_count, r.transcript_text, r.preview_text, r.title, r.updated_at) == (0, "", "(parse failed)", None, None) for r in failed.values())


def test_ranges_are_dealt_by_file_and_start(spark):
    one = spark.createDataFrame([("claude", "/f", 0, 1000), ("claude", "/e", 0, 0)], files.LISTED)
    got = sorted((r.source_path, r.first, r.last) for r in files.ranges(one, 300).collect())
    assert got == [("/e", 0, None), ("/f", 0, 300), ("/f", 300, 600), ("/f", 600, 900), ("/f", 900, None)]


# ---- side tables


def test_threads_by_ranges_of_row_ids(spark, tmp_path):
    make = "create table threads (id text, title text, cwd text, created_at int, updated_at int, rollout_path text, first_user_message text)"

    def made(name, rows, create=make):
        db = sqlite3.connect(tmp_path / name)
        db.execute(create)
        db.executemany("insert into threads values (?,?,?,?,?,?,?)", rows)
        db.commit()
        db.close()
        return str(tmp_path / name)

    rows = [(f"t{k % 7}", f"title {k}", None, k, None, "/r", "f") for k in range(23)]
    path = made("a.sqlite", rows)
    assert len(files._Threads(path, 5).partitions()) == 5
    want = {r[0]: r[1] for r in rows}  # the last of an id
    for size in (3, 50_000):
        assert {r.id: r.title for r in files.threads(spark, path, size).collect()} == want
    keyless = made("b.sqlite", rows[:7], make.replace("id text", "id text primary key") + " without rowid")
    assert {r.id for r in files.threads(spark, keyless).collect()} == set(want)
    assert files.threads(spark, made("c.sqlite", [])).collect() == [] and files.threads(spark, str(tmp_path / "none")).collect() == []
    assert files.threads(spark, made("d.sqlite", [*rows, ("x", 5, None, "no number", None, None, None)]), 4).collect() == []  # one bad row drops all
    (tmp_path / "e.sqlite").write_bytes(b"no database" * 500)
    assert files.threads(spark, str(tmp_path / "e.sqlite")).collect() == []
    raw = bytearray(open(path, "rb").read())
    raw[4096:] = b"\xff" * (len(raw) - 4096)  # the pages of the table, not the header
    (tmp_path / "f.sqlite").write_bytes(raw)
    assert files.threads(spark, str(tmp_path / "f.sqlite"), 3).collect() == []


def test_titles_by_byte_ranges(spark, tmp_path):
    path = put(tmp_path / "i.jsonl", *(json.dumps({"id": f"q{k % 5}", "thread_name": f"n{k}"}) for k in range(20)), "bad", '{"id": 1, "thread_name": "x"}', "[]")
    for size in (None, 30):
        assert {r.id: r.thread_name for r in files.index_titles(spark, path, size).collect()} == {f"q{k}": f"n{15 + k}" for k in range(5)}
    with open(path, "ab") as f:
        f.write(b"\xff\n")
    assert files.index_titles(spark, path, 30).collect() == [] and files.index_titles(spark, str(tmp_path / "no")).collect() == []


# ---- the store


@pytest.fixture
def roots(tmp_path):
    for k in range(4):
        put(tmp_path / "c" / "p" / f"s{k}.jsonl", say(f"Sess{k}", f"question {k} about shared words"))
    return [("claude", str(tmp_path / "c"))]


def ids(s):
    return sorted(r.id for r in s.table("sessions").select("id").collect())


def test_two_writers_both_stay_visible(spark, tmp_path, roots, monkeypatch):
    path = str(tmp_path / "store")
    a, b = store.Store(spark, path), store.Store(spark, path)
    assert a.reindex(roots) == (4, 4)
    other = [("claude", str(tmp_path / "d"))]
    put(tmp_path / "d" / "x.jsonl", say("other", "from the second writer"))
    put(tmp_path / "c" / "p" / "s9.jsonl", say("Sess9", "from the first writer"))
    write, before = store.Store._write, []

    def late(self, layer, *rest):
        """While the first writer writes its layer, the second commits."""
        totals = write(self, layer, *rest)
        if self is a and not before:
            before.append(1)
            assert b.reindex(other) == (1, 1)
        return totals

    monkeypatch.setattr(store.Store, "_write", late)
    assert a.reindex(roots) == (5, 1)
    now = a._manifest()
    assert len(now["layers"]) == 3 and now["number"] == 3 and ids(a) == ["claude:Sess0", "claude:Sess1", "claude:Sess2", "claude:Sess3", "claude:Sess9", "claude:other"]
    # the same file from both: the first starts again, and finds it read
    before.clear()
    put(tmp_path / "d" / "x.jsonl", say("other", "from the second writer, longer"))
    found = a.reindex(other)
    assert found == (1, 0) and len(a._manifest()["layers"]) == 4 and len(os.listdir(path)) == 5  # no layer is left over
    assert a.rows().where("id = 'claude:other'").first().title.endswith("longer")


def test_reads_join_only_layers_that_replace(spark, tmp_path, roots):
    s = store.Store(spark, str(tmp_path / "store"))
    s.reindex(roots)
    put(tmp_path / "c" / "p" / "new.jsonl", say("New", "a new session of shared words"))
    s.reindex(roots)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(s.table("sessions")) and "Join" not in plan(s.index()[0]) and len(ids(s)) == 5
    put(tmp_path / "c" / "p" / "s1.jsonl", say("Sess1", "changed"), say("Sess1", "changed again"))
    s.reindex(roots)
    assert plan(s.table("sessions")).count("Join LeftAnti") == 1  # the layer of one of three
    assert len(ids(s)) == 5 and s.rows().where("id = 'claude:Sess1'").first().message_count == 2
    assert s.best("shared", 3) is None  # counts hold the replaced rows too


def test_names_are_ranges(spark, tmp_path, roots):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.named("x").collect() == []
    s.reindex(roots)
    own = s.named("claude:sess1")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(low,claude:sess1)" in plan and "LessThan(low,claude:sess1" in plan
    for value in ("claude:Sess1", "CLAUDE:s", "sess", "Sess3", "", "claude:_ess2", "%3", "x", "claude:Sess1 "):
        assert sorted(r.id for r in s.named(value).collect()) == sorted(r.id for r in search.resolve(s.table("sessions"), value).collect()), value
    assert s.find("sess2").first().transcript_text.endswith("question 2 about shared words")
    with pytest.raises(LookupError, match="ambiguous"):
        s.find("sess")
    s.clear()
    assert ids(s) == [] and s.index()[0].count() == 0 and s.best("shared", 3) is None and s.named("sess1").collect() == []


def test_progress_rises_while_files_are_read():
    seen, now = [], [0]

    def read():
        now[0] += 7
        return now[0]

    with store.reporting(read, 50, seen.append):
        import time

        time.sleep(store.REPORT_SECONDS * 5)
    assert seen[-1] == 50 and seen == sorted(set(seen)) and len(seen) > 2


def test_accumulated_progress(spark, tmp_path, roots):
    said = []
    store.Store(spark, str(tmp_path / "store")).reindex(roots, progress=lambda *n: said.append(n))
    assert said[-1] == (4, 4, 4)


def test_put_new_is_exclusive(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    assert fs.put_new(spark, path, "one é") and not fs.put_new(spark, path, "two") and fs.read_text(spark, path) == "one é"
    assert fs.names(spark, str(tmp_path / "m")) == ["1.json"] and fs.names(spark, str(tmp_path / "none")) == []


# ---- impacts


def test_pruned_top_is_the_top(spark):
    rng = random.Random(8)
    words = ["common"] * 4 + ["often"] * 3 + ["some"] * 2 + ["rare"] + [f"w{k}" for k in range(600)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for k in range(1500)] + [(5000, ""), (5001, None), (5002, "common " * 50)]
    table = spark.createDataFrame(rows, "id long, body string")
    post, lens = fts.postings(table, ("body",)).cache(), fts.lengths(table, ("body",)).cache()

    def part(test, avg):
        own = fts.impacts(post.where(test), lens.where(test), avg).cache()
        docs, total = lens.where(test).agg(F.count("*"), F.sum("len")).first()
        return fts.Part(own, fts.headers(own).cache(), docs, total, avg)

    parts = [part("id < 700", 35.0), part("id >= 700", 90.0)]  # levels of other averages than the whole's
    shares = {}
    for query in ("common", "rare", "common often", "some rare common", "common common w3", "nothing", "nothing rare", "w1 w2 w3 w4"):
        for k in (1, 10, 40):
            got = fts.top_pruned(parts, query, k)
            assert [tuple(r) for r in got.best.collect()] == [tuple(r) for r in fts.top(post, lens, query, k).collect()], (query, k)
            shares[query, k] = got.read / max(1, got.postings)
    assert fts.top_pruned(parts, "a-b", 3) is None and fts.top_pruned(parts, "--", 3).best.collect() == []
    assert shares["common", 1] < 0.15 and shares["common", 10] < 0.4, shares


def test_store_answers_by_impacts(spark, tmp_path, roots):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.best("x", 3) is None
    s.reindex(roots)
    put(tmp_path / "c" / "p" / "new.jsonl", say("New", "shared shared shared"))
    s.reindex(roots)
    got = s.best("shared words", 3)
    assert [tuple(r) for r in got.best.collect()] == [tuple(r) for r in fts.top(*s.index(), "shared words", 3).collect()]
    plan = got.best._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,shared)" in plan and "GreaterThanOrEqual(level" in plan
    assert s.best("shared-words", 3) is None  # a phrase needs positions
    hits = Engine(spark, Config(store=s.path)).search("shared", Filters(limit=1), as_of="2024-02-01 00:00:00")
    assert [h.id for h in hits.collect()] == ["claude:New"]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(id, [") >= 1 and plan.count("In(session_id, [") >= 1  # the candidates are looked up, the tables not shuffled whole


def test_accents_of_three_scripts(spark):
    rows = spark.createDataFrame([(1, "Ελλάδα και Ὅμηρος"), (2, "Việt Nam đường phố"), (3, "ёлка й"), (4, "été und Über"), (5, "가나 が")], "id long, body string")
    found = lambda q: [r.id for r in fts.top_scanned(rows, q, 9, ("body",)).collect()]
    for q, want in (("ελλαδα", 1), ("Ελλάδα", 1), ("ομηρος", 1), ("viet", 2), ("VIỆT", 2), ("pho", 2), ("елка", 3), ("été", 4), ("ete", 4), ("uber", 4), ("가나", 5)):
        assert found(q) == [want], q
    assert text.query_terms("été") == [["ete"]]


# ---- the stream


def test_stream_of_changes_restarts_where_it_was(spark, tmp_path, roots):
    s, point = store.Store(spark, str(tmp_path / "store")), str(tmp_path / "point")
    batches = []
    absorb = store.Store.absorb

    def run():
        query = refresh.watch(s, roots, point, seconds=None)
        assert query.awaitTermination(120)
        assert query.exception() is None

    def counted(self, found, *a, **k):
        batches.append(sorted(os.path.basename(r.source_path) for r in found.collect()))
        return absorb(self, found, *a, **k)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(store.Store, "absorb", counted)
        run()
        put(tmp_path / "c" / "p" / "s1.jsonl", say("Sess1", "one"), say("Sess1", "two"))
        put(tmp_path / "c" / "p" / "s7.jsonl", say("Sess7", "new"))
        run()  # from the checkpoint: what changed, and nothing else
        run()
    assert [b for b in batches if b] == [["s0.jsonl", "s1.jsonl", "s2.jsonl", "s3.jsonl"], ["s1.jsonl", "s7.jsonl"]]
    assert len(ids(s)) == 5 and s.rows().where("id = 'claude:Sess1'").first().message_count == 2


def test_log_of_listings(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FOLD_AFTER", 3)
    monkeypatch.setattr(changes, "PART_FILES", 2)
    root, log = tmp_path / "r", str(tmp_path / "log")
    reader = lambda: changes._Changes([("claude", str(root))], [], log)
    r = reader()
    assert r.initialOffset() == {"listing": 0} == r.latestOffset()  # the root is missing
    for k in range(5):
        put(root / f"{k}.jsonl", "x")
    assert r.latestOffset() == {"listing": 1} == r.latestOffset()
    own = r.partitions({"listing": 0}, {"listing": 1})
    assert len(own) == 3 and sorted(e[1][-7:] for p in own for e in r.read(p)) == [f"{k}.jsonl" for k in range(5)]
    for k in range(2, 5):
        put(root / "0.jsonl", "x" * k)
        assert r.latestOffset() == {"listing": k}
        (entry,) = [e for p in r.partitions({"listing": k - 1}, {"listing": k}) for e in r.read(p)]
        assert entry[1].endswith("0.jsonl") and entry[3:] == (k + 1, k)
    r.commit({"listing": 3})  # folded: the entries that are done
    assert sorted(os.listdir(log)) == ["0000000003.state", "0000000004.jsonl"]
    again = reader()  # a driver that starts anew knows all of it
    assert again.latestOffset() == {"listing": 4} and again.known == r.known
    one, two = reader(), reader()  # two drivers by mistake: one entry
    one.latestOffset()
    two.latestOffset()
    put(root / "6.jsonl", "x")
    assert one.latestOffset() == {"listing": 5} and two.latestOffset() == {"listing": 5}
