"""Changed session files as a stream: a streaming data source whose offsets are numbers of listings.

Each time Spark asks for the latest offset, the roots are listed and compared
with what the log knows; files whose time or size differs become the next entry
of the log, a file of JSON lines that is created exclusively and whole. An
offset is the number of an entry, so it stays small in the checkpoint, and a
batch is the entries between two offsets: after a restart nothing is read twice
and nothing is left out. Committed entries are folded into one snapshot now and
then. What the log knows of the files is held by the reader, in the driver's
Python process, as Spark's own file source holds what it has seen.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import fs
from ..sources.files import LISTED, Listing

#: Files of an entry that a task gives out, and committed entries that are folded into a snapshot.
PART_FILES, FOLD_AFTER = 10_000, 64


class _Changes(DataSourceStreamReader):
    def __init__(self, roots: list[tuple[str, str]], ignores: list[str], log: str):
        self.listing, self.log = Listing(roots, ignores), log
        #: Number of the last entry that is known, and (provider, path) -> (time, size) as of it.
        self.number, self.known = 0, {}

    def _entry(self, number: int) -> str:
        return os.path.join(self.log, f"{number:010d}.jsonl")

    def _entries(self, ending: str) -> list[int]:
        found = os.listdir(self.log) if os.path.isdir(self.log) else []
        return sorted(int(n.removesuffix(ending)) for n in found if n.endswith(ending) and n.removesuffix(ending).isdigit())

    def _learn(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            for provider, file, mtime, size in map(json.loads, f):
                self.known[provider, file] = (mtime, size)

    def _catch_up(self) -> None:
        """Read the last snapshot, if nothing is known yet, and all entries after what is known."""
        if not self.number and (folded := self._entries(".state")):
            self._learn(os.path.join(self.log, f"{folded[-1]:010d}.state"))
            self.number = folded[-1]
        for number in self._entries(".jsonl"):
            if number > self.number:
                self._learn(self._entry(number))
                self.number = number

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        found = {(e[0], e[1]): (e[2], e[3]) for part in self.listing.partitions() for e in self.listing.read(part)}
        changed = [(*key, *at) for key, at in sorted(found.items()) if self.known.get(key) != at]
        if changed and fs.put_new_file(self._entry(self.number + 1), "".join(json.dumps(c) + "\n" for c in changed)):
            self.known |= {(c[0], c[1]): (c[2], c[3]) for c in changed}
            self.number += 1
        return {"listing": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for number in range(start["listing"] + 1, end["listing"] + 1):
            with open(self._entry(number), encoding="utf-8") as f:
                n = sum(1 for _ in f)
            out += [InputPartition((number, at)) for at in range(0, n, PART_FILES)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, at = partition.value
        with open(self._entry(number), encoding="utf-8") as f:
            for line in itertools.islice(f, at, at + PART_FILES):
                yield (*json.loads(line), number)

    def commit(self, end: dict) -> None:
        done = [n for n in self._entries(".jsonl") if n <= end["listing"]]
        if len(done) < FOLD_AFTER:
            return
        fold = _Changes([], [], self.log)
        fold._catch_up_to(done[-1])
        fs.put_new_file(os.path.join(self.log, f"{done[-1]:010d}.state"), "".join(json.dumps((*key, *at)) + "\n" for key, at in fold.known.items()))
        for number in done:
            os.unlink(self._entry(number))

    def _catch_up_to(self, number: int) -> None:
        for k in self._entries(".state")[-1:]:
            self._learn(os.path.join(self.log, f"{k:010d}.state"))
        for k in self._entries(".jsonl"):
            if k <= number:
                self._learn(self._entry(k))


class SessionChanges(DataSource):
    """Format `sessionchanges`, for readStream; options roots and ignores as of `sessionfiles`, log: the
    folder of the log, one for each stream, which all who read the session files can read."""

    @classmethod
    def name(cls) -> str:
        return "sessionchanges"

    def schema(self) -> str:
        return LISTED + ", listing long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes([tuple(x) for x in json.loads(self.options["roots"])], json.loads(self.options.get("ignores", "[]")), self.options["log"])
