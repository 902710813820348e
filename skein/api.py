"""The engine: one object over a store, with the queries of the command line and the tool server."""

from __future__ import annotations

import datetime as dt
import os
import re
import shlex
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, udfs
from .functions.fuzzy import fuzzy
from .operators import render, search
from .operators.store import Store
from .schema import PROVIDERS, Filters
from .sources import files as source
from .sources.config import Config

BINARIES = {"claude": "claude", "codex": "codex", "cursor": "cursor"}
SAMPLES = {"claude": "claude --resume <session-id>", "codex": "codex resume <session-id>", "cursor": "not supported", "antigravity": "N/A"}


#: A date, or a date and a time with an offset, as RFC 3339 has them.
RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}:\d{2}(?:\.\d+)?)([Zz]|[+-]\d{2}:\d{2}))?")


def parse_since(value: str) -> dt.datetime:
    """A date, or a time with an offset, as UTC; digits of a second after the sixth are cut off."""
    m = RFC3339.fullmatch(value)
    try:
        if m is None or not value.isascii():
            raise ValueError
        if m[2] is None:
            return dt.datetime.fromisoformat(m[1])
        at = dt.datetime.fromisoformat(f"{m[1]}T{m[2][:15]}{m[3].upper()}")
        return at.astimezone(dt.timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError):
        raise ValueError(f"invalid --since value: {value}") from None


def current_repo(config: Config) -> str | None:
    return source.repo_root(os.getcwd()) if config.prefer_current_repo else None


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config.load()
        self.store = Store(spark, self.config.store)

    def now(self) -> str:
        return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")

    def reindex(self, full: bool = False, progress=None) -> tuple[int, int]:
        return self.store.reindex(self.config.all_roots(), self.config.codex_home, full, progress)

    def list_recent(self, f: Filters) -> DataFrame:
        return search.list_recent(self.store.table("sessions"), f)

    def search(self, query: str, f: Filters, repo: str | None = None, as_of: str | None = None, prefilter: bool = False) -> DataFrame:
        now = self.store._manifest()
        best = None if prefilter else self.store.best(query, f.limit * search.CANDIDATES, now)
        tables = self.store.table("sessions", now), self.store.table("transcripts", now)
        return search.search(*tables, query, f, as_of or self.now(), repo, self.store.index(now), fuzzy, udfs.snippet, prefilter, best and best.best)

    def resolve(self, value: str):
        return self.store.find(value).first()

    def counts_by_provider(self) -> DataFrame:
        return search.counts_by_provider(self.store.table("sessions"))

    def parse_warnings(self) -> int:
        return search.parse_warnings(self.store.table("sessions")).first()["n"]

    def export(self, value: str, form: str = "markdown") -> str:
        return self._shown(value, render.exported(form))

    def health(self) -> DataFrame:
        """provider, binary_found, roots, sample_resume, discovered_files, sessions."""
        found = source.discover(self.spark, [(p, r) for p in PROVIDERS for r in self.config.roots[p]])
        known = [(p, bool(p in BINARIES and shutil.which(BINARIES[p])), self.config.roots[p], SAMPLES[p]) for p in PROVIDERS]
        rows = self.spark.createDataFrame(known, "provider string, binary_found boolean, roots array<string>, sample_resume string")
        return search.health(rows, found, self.store.table("sessions"))

    def resume_plan(self, session) -> tuple[list[str], str | None]:
        """Command and directory that resume a session; raises where that is not possible."""
        if session["provider"] not in ("claude", "codex"):
            raise ValueError(f"resuming sessions is not supported for provider '{session['provider']}'")
        binary = BINARIES[session["provider"]]
        if shutil.which(binary) is None:
            raise ValueError(f"required binary '{binary}' is not on PATH")
        command = [binary, "--resume" if binary == "claude" else "resume", session["provider_session_id"]]
        return command, session["cwd"] if session["cwd"] and os.path.exists(session["cwd"]) else None

    def resume_command(self, value: str) -> str:
        command, cwd = self.resume_plan(self.resolve(value))
        line = render.command_line(command)
        return f"cd {shlex.quote(cwd)} && {line}" if cwd else line

    def preview(self, value: str) -> str:
        return udfs.summary_of(self.resolve(value)["transcript_text"])

    # texts of the tool server

    def search_text(self, query: str, f: Filters, repo: str | None = None) -> str:
        rows = self.search(query, f, repo).select(render.search_line().alias("t")).collect()
        return "".join(r["t"] for r in rows) or "No sessions found matching the query."

    def list_text(self, f: Filters) -> str:
        rows = self.list_recent(f).select(render.list_line().alias("t")).collect()
        return "".join(r["t"] for r in rows) or "No sessions found."

    def _shown(self, value: str, shape) -> str:
        """What shape gives for the one session that value names."""
        return self.store.find(value).select(shape.alias("t")).first()["t"]

    def session_text(self, value: str, max_lines: int | None = None) -> str:
        return self._shown(value, render.session_text(max_lines))

    def detail_text(self, value: str) -> str:
        return self._shown(value, render.detail_text())
