"""The index on disk: Parquet tables in layers, and numbered manifests that name them.

A layer holds rows of sessions, transcripts (the fat column on its own),
files_seen, the names that sessions are found by, and the full-text tables. A
refresh reads only files whose time or size changed and writes their rows as one
more layer, so its cost follows what changed; of equal keys the later layer's
rows count. After MAX_LAYERS the layers are written as one.

Several writers may work at once. Each writes its layer under a name of its own
and then creates the manifest with the next number, which succeeds for one of
them; the others lay their layer over the new manifest, or, if the layers that
came between hold files of theirs, start again from what is now there. The
manifest says of each layer which older ones it replaces rows of, as counted
when it was written, so that a read compares keys only where that is so.
Readers use the last manifest; layers that the last two do not name are deleted.
"""

from __future__ import annotations

import functools
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..sources import files as source
from ..sources import fs
from . import fts, ingest, search

TABLES = {"sessions": schema.SESSIONS, "transcripts": schema.TRANSCRIPTS, "files_seen": schema.FILES_SEEN}
#: Columns that name a row of each table; all but files_seen have the rows of a session.
KEYS = {"sessions": ["id"], "transcripts": ["session_id"], "files_seen": ["provider", "source_path"], "names": ["id"], "postings": ["id"], "lengths": ["id"]}
MANIFESTS = "manifests"
MAX_LAYERS = 8
#: Attempts of a writer, and manifests that are kept.
ATTEMPTS, KEPT = 20, 20
#: Seconds between reports of progress, and files from one to the next.
REPORT_SECONDS, REPORT_FILES = 0.2, 10


class Conflict(Exception):
    """Another writer has committed files of this one."""


def changed_files(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Discovered files that were not seen with exactly this time and size."""
    return found.join(seen.select("provider", "source_path", "mtime_ns", "size_bytes"), ["provider", "source_path", "mtime_ns", "size_bytes"], "left_anti")


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Of rows with equal keys the first in order."""
    last = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old by keys; rows of old that new does not name stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def names_of(sessions: DataFrame) -> DataFrame:
    """(low, id): what a session is found by, in small letters: its id and its provider's."""
    each = F.explode(F.array_distinct(F.array(text.ascii_lower(F.col("id")), text.ascii_lower(F.col("provider_session_id")))))
    return sessions.select(each.alias("low"), "id").where("low is not null")


@contextmanager
def reporting(done: Callable[[], int], total: int, report: Callable[[int], None]) -> Iterator[None]:
    """While the block runs, report(n) each time done() has passed another REPORT_FILES, and the total at the end."""
    over, said = threading.Event(), 0

    def watch() -> None:
        nonlocal said
        while not over.wait(REPORT_SECONDS):
            now = min(done(), total - 1)  # what is read again after a loss counts again
            if now // REPORT_FILES > said // REPORT_FILES:
                said = now
                report(now)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
    report(total)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _manifest(self) -> dict:
        """{"number", "layers": [names], "over": {layer: {older layer: [sessions, files] that it replaces}},
        "totals": {layer: [sessions, words]}, "dropped": [layers that this one let go]}."""
        for name in sorted((n for n in fs.names(self.spark, self._at(MANIFESTS)) if n.endswith(".json")), reverse=True):
            try:
                return {"number": int(name.removesuffix(".json")), **json.loads(fs.read_text(self.spark, self._at(MANIFESTS, name)) or "")}
            except ValueError:  # not closed yet
                continue
        return {"number": 0, "layers": [], "over": {}, "totals": {}, "dropped": []}

    def _part(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self._at(layer, table))

    def _layered(self, name: str, manifest: dict) -> DataFrame:
        """The rows of all layers without those that later ones replace; no join for a layer of which none does."""
        parts, which, keys = [], int(name == "files_seen"), KEYS[name]
        by = "files_seen" if which else "lengths"
        for k, layer in enumerate(manifest["layers"]):
            part = self._part(layer, name)
            later = [x for x in manifest["layers"][k + 1 :] if manifest["over"].get(x, {}).get(layer, [1, 1])[which]]
            if later:
                gone = functools.reduce(DataFrame.unionByName, (self._part(x, by).select(*KEYS[by]) for x in later)).toDF(*keys).distinct()
                part = part.join(gone, keys, "left_anti").select(*part.columns)
            parts.append(part)
        return functools.reduce(DataFrame.unionByName, parts)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        manifest = self._manifest() if manifest is None else manifest
        return self._layered(name, manifest) if manifest["layers"] else self.spark.createDataFrame([], TABLES[name])

    def index(self, manifest: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of the full text."""
        manifest = self._manifest() if manifest is None else manifest
        if not manifest["layers"]:
            empty = self.rows(manifest)
            return fts.postings(empty), fts.lengths(empty)
        return self._layered("postings", manifest), self._layered("lengths", manifest)

    def best(self, query: str, k: int, manifest: dict | None = None) -> fts.Pruned | None:
        """The k best sessions of the full text by impacts; None where only the postings give them: for a
        phrase, and while a layer replaces rows of another, whose counts hold both."""
        manifest = self._manifest() if manifest is None else manifest
        if not manifest["layers"] or any(n[0] for over in manifest["over"].values() for n in over.values()):
            return None
        parts = [fts.Part(self._part(x, "impacts"), self._part(x, "headers"), docs, words, words / docs) for x in manifest["layers"] for docs, words in [manifest["totals"][x]] if docs]
        return fts.top_pruned(parts, query, k) if parts else None

    def rows(self, manifest: dict | None = None) -> DataFrame:
        manifest = self._manifest() if manifest is None else manifest
        transcripts = self.table("transcripts", manifest).withColumnRenamed("session_id", "id")
        return self.table("sessions", manifest).join(transcripts, "id", "left").withColumn("transcript_text", F.coalesce("transcript_text", F.lit("")))

    def named(self, value: str, manifest: dict | None = None) -> DataFrame:
        """(id) of the sessions whose id or provider id is or begins with value, as search.resolve finds them.

        A value without wildcards is a range of the sorted names, which Parquet's
        statistics cut down to the row groups that hold it; with % or _ all sessions are looked at.
        """
        manifest = self._manifest() if manifest is None else manifest
        if not manifest["layers"] or "%" in value or "_" in value:
            return search.resolve(self.table("sessions", manifest), value).select("id")
        low = value.translate(str.maketrans(text.UPPER, text.LOWER))
        return self._layered("names", manifest).where((F.col("low") >= low) & (F.col("low") < low + "\U0010ffff")).select("id").distinct()

    def find(self, value: str):
        """The one session that value names, with its transcript_text; raises LookupError."""
        manifest = self._manifest()
        key = search.only([r["id"] for r in self.named(value, manifest).limit(2).collect()], value)
        session = self.table("sessions", manifest).where(F.col("id") == key)
        own = self.table("transcripts", manifest).where(F.col("session_id") == key).select(F.col("session_id").alias("id"), "transcript_text")
        return session.join(own, "id", "left").withColumn("transcript_text", F.coalesce("transcript_text", F.lit("")))

    def clear(self) -> None:
        self._publish({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}, self._manifest(), alone=True)

    def _write(self, layer: str, tables: dict[str, DataFrame], index: tuple[DataFrame, DataFrame] | None = None) -> list[int]:
        """Write the tables of a layer and what is derived from them; its [sessions, words]."""

        def write(name: str, rows: DataFrame, *order, deal=None, **options: str) -> DataFrame:
            if order:  # ranges, so that what is common is spread over tasks
                rows = rows.repartitionByRange(*(deal or order)).sortWithinPartitions(*order)
            rows.write.mode("overwrite").options(**{f"parquet.{k}": v for k, v in options.items()}).parquet(self._at(layer, name))
            return self._part(layer, name)

        sessions = write("sessions", tables["sessions"], "provider", F.desc("updated_at"), **{"bloom.filter.enabled#id": "true"})
        transcripts = write("transcripts", tables["transcripts"], **{"bloom.filter.enabled#session_id": "true"})
        write("files_seen", tables["files_seen"])
        write("names", names_of(sessions), "low")
        full = sessions.join(transcripts.withColumnRenamed("session_id", "id"), "id", "left")
        postings, lengths = index or (fts.postings(full), fts.lengths(full))
        postings, lengths = write("postings", postings, "term", "id"), write("lengths", lengths)
        docs, words = lengths.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        order = ("term", F.desc("level"), "id")
        rows = fts.impacts(postings, lengths, words / docs if docs else 0.0)
        impacts = write("impacts", rows, *order, **{"page.size": str(64 << 10), "page.row.count.limit": "4096"})  # pages are what is left out at a time
        write("headers", fts.headers(impacts), "term", "level")
        return [docs, words]

    def _replaced(self, layer: str, older: list[str]) -> dict[str, list[int]]:
        """How many sessions and files of each older layer the layer has rows of: two joins on the narrow key tables."""
        out = {x: [0, 0] for x in older}
        for k, table in enumerate(("lengths", "files_seen")):
            if older:
                each = functools.reduce(DataFrame.unionByName, (self._part(x, table).select(*KEYS[table], F.lit(x).alias("layer")) for x in older))
                for r in each.join(self._part(layer, table).select(*KEYS[table]), KEYS[table], "left_semi").groupBy("layer").count().collect():  # a row a layer
                    out[r["layer"]][k] = r["count"]
        return out

    def _commit(self, layer: str, totals: list[int], base: dict, alone: bool = False) -> dict:
        """Put the layer over those of the last manifest, or alone in the place of base's."""
        known: dict[str, list[int]] = {}
        for _ in range(ATTEMPTS):
            now = self._manifest()
            between = [x for x in now["layers"] if x not in base["layers"]]
            kept = between if alone else now["layers"]
            known |= self._replaced(layer, [x for x in kept if x not in known])
            if any(known[x][1] for x in between):
                raise Conflict(layer)
            layers = [layer, *kept] if alone else [*kept, layer]
            over = {x: {k: n for k, n in now["over"].get(x, {}).items() if k in layers} for x in kept}
            if alone:  # kept layers lie over this one
                over = {x: {**o, layer: known[x]} for x, o in over.items()} | {layer: {}}
            else:
                over[layer] = {x: known[x] for x in kept}
            if self._put(now, layers, over, {layer: totals}):
                return self._manifest()
        raise Conflict(f"{layer}: other writers came first {ATTEMPTS} times")

    def _put(self, now: dict, layers: list[str], over: dict, totals: dict) -> bool:
        """Create the manifest after now; False if another writer has."""
        number = now["number"] + 1
        known = {x: n for x, n in (now["totals"] | totals).items() if x in layers}
        made = {"layers": layers, "over": over, "totals": known, "dropped": [x for x in now["layers"] if x not in layers]}
        if not fs.put_new(self.spark, self._at(MANIFESTS, f"{number:010d}.json"), json.dumps(made)):
            return False
        for old in now["dropped"]:
            fs.delete(self.spark, self._at(old))
        if number > KEPT:
            fs.delete(self.spark, self._at(MANIFESTS, f"{number - KEPT:010d}.json"))
        return True

    def _publish(self, tables: dict[str, DataFrame], base: dict, alone: bool = False) -> None:
        """Write rows as a layer over the others, or alone; then, if there are many, all layers as one."""
        layer = f"v{uuid.uuid4().hex}"
        totals = self._write(layer, tables)
        try:
            now = self._commit(layer, totals, base, alone)
        except Conflict:
            fs.delete(self.spark, self._at(layer))
            raise
        if len(now["layers"]) > MAX_LAYERS:
            self._compact(now)

    def _compact(self, old: dict) -> None:
        """Write the layers of a manifest as one that takes their place under those that came since; given up if they are no longer there."""
        whole = f"v{uuid.uuid4().hex}"
        totals = self._write(whole, {n: self.table(n, old) for n in TABLES}, self.index(old))
        for _ in range(ATTEMPTS):
            now = self._manifest()
            n = len(old["layers"])
            if now["layers"][:n] != old["layers"]:
                break
            since = now["layers"][n:]
            summed = lambda o: [sum(o.get(x, [1, 1])[k] for x in old["layers"]) for k in (0, 1)]
            over = {x: {**{k: v for k, v in now["over"][x].items() if k in since}, whole: summed(now["over"][x])} for x in since}
            if self._put(now, [whole, *since], {whole: {}, **over}, {whole: totals}):
                return
        fs.delete(self.spark, self._at(whole))

    def absorb(self, found: DataFrame, codex_home: str = "", **lookups) -> int:
        """Publish those of the found files that the store does not know as they are; how many they are."""
        for _ in range(ATTEMPTS):
            try:
                return self.apply(found, self._manifest(), codex_home, **lookups)
            except Conflict:  # what the other writer has published is known now
                continue
        raise Conflict("other writers refresh the same files")

    def reindex(self, roots: list[tuple[str, str]], codex_home: str = "", full: bool = False, progress: Callable[[int, int, int], None] | None = None, **lookups) -> tuple[int, int]:
        """(files found, files read). Sessions of deleted files stay until a full refresh, which
        replaces the index only when it is complete. Where files claim one session id, the one
        discovered last (by path) counts. progress gets (files found, files to read, files read so far) about
        every ten files while they are read, and once at the end."""
        for _ in range(ATTEMPTS):
            found = source.discover(self.spark, roots).cache()
            try:
                base, seen = self._manifest(), found.count()
                return seen, self.apply(found, base, codex_home, full, progress and (lambda of, n: progress(seen, of, n)), **lookups)
            except Conflict:
                continue
            finally:
                found.unpersist()
        raise Conflict("other writers refresh the same files")

    def apply(self, found: DataFrame, base: dict, codex_home: str = "", full: bool = False, progress: Callable[[int, int], None] | None = None, **lookups) -> int:
        """Read those of the found files that base does not know as they are, and publish them; how many they are."""
        seen_before = self.spark.createDataFrame([], TABLES["files_seen"]) if full else self.table("files_seen", base)
        changed = changed_files(found, seen_before).cache()
        try:
            updated = changed.count()
            if updated == 0:
                if full or not base["layers"]:
                    self._publish({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}, base, alone=True)
                return 0
            read = self.spark.sparkContext.accumulator(0)
            side = source.threads(self.spark, os.path.join(codex_home, "state_5.sqlite")), source.index_titles(self.spark, os.path.join(codex_home, "session_index.jsonl"))
            new = ingest.sessions(ingest.read(changed, counted=read), *side, **lookups).cache()
            try:
                winners = latest(new, ["id"], F.desc("source_path"))
                at = F.lit(time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())).cast("timestamp")
                with reporting(lambda: read.value, updated, lambda n: progress and progress(updated, n)):
                    self._publish(
                        {
                            "sessions": winners.select(*schema.SESSIONS.names),
                            "transcripts": winners.select(F.col("id").alias("session_id"), "transcript_text"),
                            "files_seen": changed.select("provider", "source_path", "mtime_ns", "size_bytes", at.alias("last_indexed_at"), F.lit(None).cast("string").alias("content_hash")),
                        },
                        base, alone=full,
                    )
            finally:
                new.unpersist()
            return updated
        finally:
            changed.unpersist()
