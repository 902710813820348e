"""Keeping the index fresh: at most one refresh in a while, or a stream of changed files.

Session files grow in place, so Spark's file stream, which knows files by name
alone, would miss their new lines; the stream here follows times and sizes.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store as layers
from ..sources import files as source
from ..sources.ignores import global_patterns
from .changes import SessionChanges

LEAST_SECONDS = 1.5


class Refresher:
    """Call it before a query; errors are logged, and the old index answers."""

    def __init__(self, reindex: Callable[[], object], least: float = LEAST_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.reindex, self.least, self.clock, self.last = reindex, least, clock, None

    def __call__(self) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.least:
            return False
        try:
            self.reindex()
        except Exception:  # a broken file or a full disk must not take queries down
            logging.exception("refresh failed")
        self.last = self.clock()
        return True


def changes(spark, roots: list[tuple[str, str]], log: str, ignores: list[str] | None = None) -> DataFrame:
    """A stream of the session files below the roots, each as often as its time or size changes: LISTED
    columns and listing, the number of the listing that found it so."""
    spark.dataSource.register(SessionChanges)
    reader = spark.readStream.format("sessionchanges").option("roots", json.dumps(roots)).option("log", log)
    files = reader.option("ignores", json.dumps(global_patterns() if ignores is None else ignores)).load()
    return files.where(source.is_session(F.col("source_path"), F.col("provider")))


def watch(store: layers.Store, roots: list[tuple[str, str]], checkpoint: str, codex_home: str = "", seconds: float | None = 5.0, **lookups):
    """A streaming query that publishes changed files as they come (with seconds None: those there are,
    then it ends). A batch that is run again after a loss finds its files in the store and adds nothing."""

    def publish(batch: DataFrame, number: int) -> None:
        found = layers.latest(batch, ["provider", "source_path"], F.desc("listing")).select("provider", "source_path", "mtime_ns", "size_bytes")
        layers.Store(batch.sparkSession, store.path).absorb(found, codex_home, **lookups)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    stream = changes(store.spark, roots, os.path.join(checkpoint, "listings"))
    return stream.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(publish).start()
