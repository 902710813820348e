"""The tables' conversations as real files of all providers, through discovery, ranges, side tables and the
store, against the SQL that gives their sessions straight from the conversations."""

import os
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import ingest, store
from skein.plans import registry, transcripts
from skein.schema import PROVIDERS
from skein.sources import files
from test_oracle import TABLES, normal

#: What does not depend on where the files lie.
COLUMNS = [c for c in registry._INGESTED if c not in ("source_path", "parse_warning")]


@pytest.fixture(scope="module")
def home(spark, sf_dir, tmp_path_factory):
    """(root, [(provider, its root)], files): every fifteenth file is no UTF-8, as the SQL has it."""
    root = tmp_path_factory.mktemp("home")
    rows = transcripts.contents(spark, sf_dir).collect()
    for r in rows:
        path = root / r.source_path.removeprefix("/h/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(r.content.encode() if r.error is None else b'{"a": 1}\n\xff\n')
        os.utime(path, ns=(r.mtime_ns, r.mtime_ns))
    threads, titles = (d.collect() for d in transcripts.side(spark, sf_dir))
    db = sqlite3.connect(root / "state_5.sqlite")
    db.execute("create table threads (id text, title text, cwd text, created_at int, updated_at int, rollout_path text, first_user_message text)")
    db.executemany("insert into threads values (?,?,?,?,?,?,?)", [tuple(t) for t in threads])
    db.commit()
    db.close()
    (root / "session_index.jsonl").write_text("".join(f'{{"id": "{t.id}", "thread_name": "{t.thread_name}"}}\n' for t in titles))
    folders = dict(zip(PROVIDERS, ("claude", "codex", "cursor", "gem")))
    return root, [(p, str(root / f)) for p, f in folders.items() if (root / f).is_dir()], rows


@pytest.fixture(scope="module")
def wanted(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db.sql(f"with {transcripts.SESSIONS_SQL} select {', '.join(COLUMNS)}, parse_warning from ingested").df()


def test_discovery_finds_each_file_as_it_is(spark, home):
    root, roots, rows = home
    found = {r.source_path: (r.provider, r.mtime_ns, r.size_bytes) for r in files.discover(spark, roots, []).collect()}
    assert found == {str(root / r.source_path.removeprefix("/h/")): (r.provider, r.mtime_ns, r.size_bytes if r.error is None else 11) for r in rows}


@pytest.mark.parametrize("size", [None, 300])
def test_read_in_ranges_they_are_the_sessions_of_the_sql(spark, home, wanted, size):
    root, roots, _ = home
    side = files.threads(spark, str(root / "state_5.sqlite"), 2), files.index_titles(spark, str(root / "session_index.jsonl"), 40)
    got = ingest.sessions(ingest.read(files.discover(spark, roots, []), size), *side, **transcripts.LOOKUPS).select(*COLUMNS, "parse_warning").toPandas()
    assert normal(got[got.parse_warning.isna()][COLUMNS]) == normal(wanted[wanted.parse_warning.isna()][COLUMNS])
    bad = got[got.parse_warning.notna()]
    assert sorted(bad.id) == sorted(wanted[wanted.parse_warning.notna()].id) and all("byte 0xff in position 9" in w for w in bad.parse_warning)


def test_the_store_holds_them_and_reads_nothing_twice(spark, home, wanted, tmp_path):
    root, roots, rows = home
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.reindex(roots, str(root), **transcripts.LOOKUPS) == (len(rows), len(rows))
    got = s.rows().select(*COLUMNS, "parse_warning").toPandas()
    assert normal(got[got.parse_warning.isna()][COLUMNS]) == normal(wanted[wanted.parse_warning.isna()][COLUMNS]) and len(got) == len(wanted)
    assert s.reindex(roots, str(root), **transcripts.LOOKUPS) == (len(rows), 0)
    totals = s.table("sessions").groupBy("provider").agg(F.count("*").alias("n")).collect()
    assert sum(t.n for t in totals) == len(rows) == s.table("files_seen").count()
