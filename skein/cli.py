"""Command line: python -m skein.cli COMMAND."""

from __future__ import annotations

import argparse
import shlex
import subprocess
import sys

from pyspark.sql import SparkSession

from .api import Engine, current_repo, parse_since
from .functions import text
from .operators import render
from .schema import Filters, provider
from .sources.config import Config, expand


#: Files from which a refresh reports its progress.
LONG = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("reindex").add_argument("--full", action="store_true")
    for name in ("list", "search"):
        q = sub.add_parser(name)
        if name == "search":
            q.add_argument("query")
        q.add_argument("--provider", type=provider)
        q.add_argument("--path")
        q.add_argument("--since", type=parse_since)
        q.add_argument("--limit", type=int, default=25)
        q.add_argument("--warnings-only", action="store_true")
    show = sub.add_parser("show")
    show.add_argument("id")
    show.add_argument("--raw", action="store_true")
    resume = sub.add_parser("resume")
    resume.add_argument("id")
    resume.add_argument("--yes", action="store_true")
    resume.add_argument("--dry-run", action="store_true")
    export = sub.add_parser("export")
    export.add_argument("id")
    export.add_argument("--format", default="markdown")
    export.add_argument("-o", "--output")
    for name in ("doctor", "paths", "preview", "serve"):
        q = sub.add_parser(name)
        if name == "preview":
            q.add_argument("id")
    return p


def filters(args: argparse.Namespace, config: Config) -> Filters:
    path = expand(args.path) if args.path and args.path.startswith("~") else args.path
    return Filters(args.provider, path, args.since, args.limit or config.default_limit, args.warnings_only)


def paths_text(config: Config) -> str:
    lines = [("Config", Config.path()), ("Store", config.store), ("Cache", config.cache)]
    lines += [(f"{p.capitalize()} roots", ", ".join(r)) for p, r in config.roots.items()]
    return "\n".join(f"{k}: {v}" for k, v in [*lines, ("Codex metadata home", config.codex_home)])


def progress(seen: int, updated: int, done: int) -> None:
    """Says on standard error, in one line that is written over, how far a long refresh is."""
    if seen >= LONG and updated:
        print(f"\rindexing: {done} of {updated} changed files ({seen} found)", end="\n" if done == updated else "", file=sys.stderr, flush=True)


def run(args: argparse.Namespace, engine: Engine) -> str:
    """Runs a command and returns what it prints."""
    if args.command == "paths":
        return paths_text(engine.config)
    if args.command == "reindex":
        seen, updated = engine.reindex(args.full, progress)
        return f"{seen} files seen, {updated} indexed"
    engine.reindex()
    as_of = text.as_timestamp(engine.now())
    if args.command == "list":
        rows = engine.list_recent(filters(args, engine.config)).select(render.row_text(as_of).alias("t")).collect()
        return "\n".join(r["t"] for r in rows) or "no sessions found"
    if args.command == "search":
        hits = engine.search(args.query, filters(args, engine.config), current_repo(engine.config))
        return "\n".join(r["t"] for r in hits.select(render.hit_text(as_of, args.query).alias("t")).collect()) or "no sessions found"
    if args.command == "show":
        return engine.resolve(args.id)["transcript_text"] if args.raw else engine.detail_text(args.id)
    if args.command == "preview":
        return engine.preview(args.id)
    if args.command == "export":
        out = engine.export(args.id, args.format)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(out)
            return ""
        return out
    if args.command == "doctor":
        out = [f"Store: {engine.config.store}", f"Parse warnings indexed: {engine.parse_warnings()}"]
        for h in engine.health().collect():
            out.append(
                f"\nProvider: {h['provider']}\n  binary: {'present' if h['binary_found'] else 'missing'}\n  roots: {', '.join(h['roots'])}\n  files discovered: {h['discovered_files']}\n"
                f"  sessions indexed: {h['sessions']}\n  sample resume: {h['sample_resume']}"
            )
        return "\n".join(out)
    command, cwd = engine.resume_plan(engine.resolve(args.id))
    shown = (f"cd {shlex.quote(cwd)} && " if cwd else "") + render.command_line(command)
    if args.dry_run:
        return shown
    if args.yes or input(f"Run {shown}? [y/N]: ").strip().lower() in ("y", "yes"):
        subprocess.run(command, cwd=cwd, check=False)
    return shown


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, Config.load(args.config))
    if args.command == "serve":
        from .rpc import Server

        Server(engine).serve()
        return 0
    try:
        print(run(args, engine))
    except (ValueError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
