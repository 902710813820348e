"""Session files: a Python data source that lists them, and readers of their content.

Listing and reading are apart, so that unchanged files are dropped by a join
before any content is read. Spark's own file sources skip names that begin
with a dot or underscore, which hold sessions here.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ignores import Ignores, global_patterns

LISTED = "provider string, source_path string, mtime_ns long, size_bytes long"
THREADS = "id string, title string, cwd string, created_at long, updated_at long, rollout_path string, first_user_message string"


def _entry(provider: str, path: str) -> tuple[str, str, int, int]:
    try:
        stat = os.lstat(path)
        return provider, path, max(0, stat.st_mtime_ns), stat.st_size
    except OSError:
        return provider, path, 0, 0


class Listing(DataSourceReader):
    def __init__(self, roots: list[tuple[str, str]], ignores: list[str]):
        self.roots, self.ignored = roots, Ignores(ignores)

    def partitions(self) -> list[InputPartition]:
        """One for what lies right in a root, one for each directory in it; missing roots have none."""
        out = []
        for provider, root in self.roots:
            if os.path.isdir(root):
                out.append(InputPartition((provider, root, root, False)))
                folders = [e for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
                out += [InputPartition((provider, root, e.path, True)) for e in folders if not self.ignored(e.name, True)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        provider, root, top, deep = partition.value
        for folder, dirs, names in os.walk(top, followlinks=False):
            below = os.path.relpath(folder, root) + "/" if folder != root else ""
            if deep:
                yield _entry(provider, folder)  # a directory may bear the name of a session file
            for name in names:
                if not self.ignored(below + name, False):
                    yield _entry(provider, os.path.join(folder, name))
            dirs[:] = [d for d in dirs if not self.ignored(below + d, True)] if deep else []


class SessionFiles(DataSource):
    """Format `sessionfiles`; options roots: JSON list of [provider, directory], ignores: JSON
    list of git ignore lines."""

    @classmethod
    def name(cls) -> str:
        return "sessionfiles"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return Listing([tuple(x) for x in json.loads(self.options.get("roots", "[]"))], json.loads(self.options.get("ignores", "[]")))


def is_session(path: Column, provider: Column) -> Column:
    """Which files are sessions of their provider."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    jsonl = name.rlike(r".\.jsonl$")
    has = lambda part: F.array_contains(parts, part)
    return (
        F.when(provider == "claude", jsonl & ~has("memory") & ~has("subagents")).when(provider == "codex", jsonl)
        .when(provider == "cursor", jsonl & has("agent-transcripts") & ~has("subagents")).when(provider == "antigravity", name == "transcript.jsonl").otherwise(False)
    )


def discover(spark: SparkSession, roots: list[tuple[str, str]], ignores: list[str] | None = None) -> DataFrame:
    """provider, source_path, mtime_ns, size_bytes of all session files below the roots, but for
    those that the user's global git ignore file (or the lines given) hides."""
    spark.dataSource.register(SessionFiles)
    files = spark.read.format("sessionfiles").option("roots", json.dumps(roots)).option("ignores", json.dumps(global_patterns() if ignores is None else ignores)).load()
    return files.where(is_session(F.col("source_path"), F.col("provider")))


#: Bytes of a file that one task reads, and of lines and their number that it holds at once.
RANGE_BYTES, HELD_BYTES, HELD_LINES = 32 << 20, 4 << 20, 4096
PLACED = LISTED + ", place long, error string"


def ranges(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Listed files as rows with first and last, a byte range each, dealt over tasks whatever file they are
    of. The last range has no end: a file that has grown, or a link, is read to its end."""
    size = range_bytes or RANGE_BYTES
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = files.select("provider", "source_path", "mtime_ns", "size_bytes", F.explode(starts).alias("first"))
    last = F.when(F.col("first") + size < F.col("size_bytes"), F.col("first") + size)
    return rows.withColumn("last", last).repartition("source_path", "first")


def _lines(path: str, first: int, last: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the lines that begin in a byte range."""
    with open(path, "rb") as f:
        if first:
            f.seek(first - 1)
            while (rest := f.readline(1 << 20)) and not rest.endswith(b"\n"):
                pass  # a line that began before belongs to the range of its start
        at = f.tell()
        while last is None or at < last:
            line = f.readline()
            if not line:
                return
            yield at, line
            at += len(line)


def _bad_utf8(e: UnicodeDecodeError, at: int) -> str:
    """The error's text as decoding the whole file would give it."""
    where = f"byte 0x{e.object[e.start]:02x} in position {at + e.start}" if e.end - e.start == 1 else f"bytes in position {at + e.start}-{at + e.end - 1}"
    return f"UnicodeDecodeError: 'utf-8' codec can't decode {where}: {e.reason}"


def read_lines(files: DataFrame, decode: Callable[[str, str], dict], fields: pa.Schema, fields_ddl: str, range_bytes: int | None = None, counted=None) -> DataFrame:
    """The lines of listed files as PLACED rows with the fields that decode(provider, line) gives.

    place is 0 for the file itself and one more than the offset of a line for that line, so
    that it orders the lines of a file whatever ranges it is read in. What
    cannot be read, bad UTF-8 included, is a row with error, at its place. A range's task
    holds HELD_BYTES of it; a line is one value, whatever its length. counted, an accumulator, counts files begun.
    """

    def batch(own: dict, rows: list[tuple[int, dict, str | None]]) -> pa.RecordBatch:
        n = len(rows)
        head = [pa.array([own["provider"]] * n, pa.string()), pa.array([own["source_path"]] * n, pa.string()), pa.array([own["mtime_ns"]] * n, pa.int64()), pa.array([own["size_bytes"]] * n, pa.int64())]
        placed = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays([*head, *placed, *(pa.array([r[1].get(f.name) for r in rows], f.type) for f in fields)], names=["provider", "source_path", "mtime_ns", "size_bytes", "place", "error", *fields.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (row for b in batches for row in b.to_pylist()):
            rows: list[tuple[int, dict, str | None]] = [(0, {}, None)] if own["first"] == 0 else []
            held = 0
            if counted is not None and rows:
                counted.add(1)
            try:
                for at, line in _lines(own["source_path"], own["first"], own["last"]):
                    try:
                        text = line.decode("utf-8").removesuffix("\n").removesuffix("\r")
                    except UnicodeDecodeError as e:
                        rows.append((at + 1, {}, _bad_utf8(e, at)))
                        break  # the file counts as unreadable, and this is where it first is in this range
                    rows.append((at + 1, decode(own["provider"], text), None))
                    held += len(line)
                    if held >= HELD_BYTES or len(rows) >= HELD_LINES:
                        yield batch(own, rows)
                        rows, held = [], 0
            except OSError as e:
                rows.append((own["first"] + 1, {}, f"{type(e).__name__}: {e}"))
            if rows:
                yield batch(own, rows)

    return ranges(files, range_bytes).mapInArrow(run, f"{PLACED}, {fields_ddl}")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """One file as a listing; none if it is missing."""
    return spark.createDataFrame([_entry("", path)] if os.path.exists(path) else [], LISTED)


def _sound(rows: DataFrame) -> DataFrame:
    """rows (with error) if none has an error, else none of them."""
    bad = rows.agg(F.count("error").alias("_bad"))  # one row
    return rows.join(F.broadcast(bad)).where("_bad = 0").drop("_bad")


THREAD_ROWS = 50_000
THREAD_FIELDS = tuple(f.split()[0] for f in THREADS.split(", "))


def _thread_rows(path: str, low: int | None, high: int | None) -> Iterator[tuple]:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        where, bounds = ("", ()) if low is None else (" where rowid between ? and ?", (low, high))
        order = "0" if low is None else "rowid"
        for k, r in enumerate(db.execute(f"select {order}, {', '.join(THREAD_FIELDS)} from threads{where}", bounds)):
            if not (isinstance(r[1], str) and all(x is None or isinstance(x, int if n in ("created_at", "updated_at") else str) for n, x in zip(THREAD_FIELDS, r[1:]))):
                raise sqlite3.DataError("a column of another type")
            yield (*r[1:], k if low is None else r[0], None)
    finally:
        db.close()


class _Threads(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids; one part for a table that has none, or that cannot be read."""
        try:
            db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
            try:
                low, high = db.execute("select min(rowid), max(rowid) from threads").fetchone()
            finally:
                db.close()
        except sqlite3.Error:
            return [InputPartition((None, None))]
        if low is None:
            return [InputPartition((0, 0))]
        most = max(1, -(-(high - low + 1) // self.rows))
        step = -(-(high - low + 1) // min(most, 10_000))  # ids may be far apart: parts are bounded, then rows are not
        return [InputPartition((k, min(high, k + step - 1))) for k in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield from _thread_rows(self.path, *partition.value)
        except sqlite3.Error as e:
            yield (*[None] * len(THREAD_FIELDS), 0, f"{type(e).__name__}: {e}")


class ThreadTable(DataSource):
    """Format `threadtable`: the side database of session titles, in ranges of row ids; options path, rows (of a range)."""

    @classmethod
    def name(cls) -> str:
        return "threadtable"

    def schema(self) -> str:
        return THREADS + ", place long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Threads(self.options["path"], int(self.options.get("rows", THREAD_ROWS)))


def threads(spark: SparkSession, path: str, rows: int = THREAD_ROWS) -> DataFrame:
    """Rows of the side database of session titles, of equal ids the last; none if it is missing or any part of it broken."""
    if not os.path.exists(path):
        return spark.createDataFrame([], THREADS)
    spark.dataSource.register(ThreadTable)
    found = _sound(spark.read.format("threadtable").option("path", path).option("rows", str(rows)).load())
    return found.groupBy("id").agg(F.max_by(F.struct(*THREAD_FIELDS[1:]), "place").alias("t")).select("id", "t.*")


def _title(provider: str, line: str) -> dict:
    try:
        row = json.loads(line)
    except (ValueError, RecursionError):
        return {}
    good = isinstance(row, dict) and isinstance(row.get("id"), str) and isinstance(row.get("thread_name"), str)
    return {"id": row["id"], "thread_name": row["thread_name"]} if good else {}


def index_titles(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(id, thread_name) of the side index; bad lines are skipped, the last of an id counts; none if it is missing or has bad UTF-8."""
    kinds = pa.schema([("id", pa.string()), ("thread_name", pa.string())])
    found = _sound(read_lines(_listed(spark, path), _title, kinds, "id string, thread_name string", range_bytes))
    return found.where("id is not null").groupBy("id").agg(F.max_by("thread_name", "place").alias("thread_name"))


def repo_root(cwd: str | None) -> str | None:
    """The nearest directory at or above cwd that holds .git."""
    here = cwd
    while here:
        if os.path.exists(os.path.join(here, ".git")):
            return here
        up = os.path.dirname(here)
        here = up if up != here else None
    return None


def workspace(encoded: str | None, top: str = "/Users") -> str | None:
    """The existing directory that a project name with dashes for slashes stands for, more
    slashes first; None if there is none. Only directories that exist are gone into."""
    parts = (encoded or "").split("-")
    if parts[0] != "Users" or len(parts) < 3:
        return None

    def below(folder: str, k: int) -> str | None:
        if k == len(parts):
            return folder
        for end in range(k + 1, len(parts) + 1):
            path = f"{folder}/{'-'.join(parts[k:end])}"
            if os.path.exists(path) if end == len(parts) else os.path.isdir(path):
                if found := below(path, end):
                    return found
        return None

    return below(top, 1)
