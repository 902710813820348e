"""Exports and console text of sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text


def rfc3339(c: Column, millis: bool = True) -> Column:
    """As 2024-01-31T10:00:00.500+00:00, with a fraction only if needed, of six digits; with millis of
    three where they say all."""
    micros = F.unix_micros(c) % 1_000_000
    short = (micros % 1000 == 0) & F.lit(millis)
    part = F.when(micros == 0, "").when(short, F.date_format(c, ".SSS")).otherwise(F.date_format(c, ".SSSSSS"))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def exported(form: str, millis: bool = True) -> Column:
    """A session with its transcript_text as text, markdown (md) or json; times as rfc3339 has them."""
    heading = F.coalesce("title", "id")
    if form == "text":
        return F.concat(heading, F.lit("\n\n"), "transcript_text", F.lit("\n"))
    if form in ("markdown", "md"):
        shape = "# %s\n\n- Provider: %s\n- Session ID: %s\n- CWD: %s\n- Updated At: %s\n\n## Preview\n\n%s\n\n## Transcript\n\n```\n%s\n```\n"
        dash = F.lit("-")
        return F.format_string(shape, heading, "provider", "provider_session_id", F.coalesce("cwd", dash), F.coalesce(rfc3339(F.col("updated_at"), millis), dash), "preview_text", "transcript_text")
    if form == "json":
        times = ("created_at", "updated_at", "last_message_at")
        names = sorted(
            "id provider provider_session_id title summary cwd repo_root created_at updated_at last_message_at preview_text source_path message_count "
            "parse_version raw_metadata_json parse_warning discovery_source transcript_text".split()
        )
        zulu = lambda n: F.regexp_replace(rfc3339(F.col(n), millis), r"\+00:00$", "Z")
        quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
        value = lambda n: F.col(n).cast("string") if n == "message_count" else quoted(zulu(n) if n in times else F.col(n))
        lines = [F.concat(F.lit(f'  "{n}": '), F.when(F.col(n).isNull(), "null").otherwise(value(n))) for n in names]
        return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    raise ValueError(f"unsupported export format: {form}")


def resume_command() -> Column:
    """The command that resumes a session; null where the provider has none."""
    ids = F.col("provider_session_id")
    return F.when(F.col("provider") == "claude", F.concat(F.lit("claude --resume "), ids)).when(F.col("provider") == "codex", F.concat(F.lit("codex resume "), ids))


def row_text(as_of: Column, match: bool = False) -> Column:
    """Two lines for a listing, a third for a warning."""
    title = F.coalesce(text.truncated(F.col("title"), 72), "preview_text")
    suffix = F.concat(F.lit(" match="), F.col("match_source"), F.lit(" score="), F.col("score")) if match else F.lit("")
    head = F.format_string("%s  %-6s  %-38s  %-72s%s", text.relative_age(F.col("updated_at"), as_of), "provider", "provider_session_id", title, suffix)
    second = F.concat(F.lit("\n  cwd="), F.coalesce("cwd", F.lit("-")), F.lit("  preview="), "preview_text")
    return F.concat(head, second, F.coalesce(F.concat(F.lit("\n  warning="), "parse_warning"), F.lit("")))


def hit_text(as_of: Column, query: str) -> Column:
    """A search result with the query's words marked."""
    mark = lambda c: text.highlighted(c, query)
    title = mark(F.coalesce(text.truncated(F.col("title"), 72), "preview_text"))
    head = F.format_string("%s  %-6s  %-38s  %s match=%s score=%d", text.relative_age(F.col("updated_at"), as_of), "provider", "provider_session_id", title, "match_source", "score")
    rest = F.concat(F.lit("\n  cwd="), F.coalesce("cwd", F.lit("-")), F.lit("  preview="), mark(F.col("preview_text")), F.lit("\n  hit["), "match_source", F.lit("]: "), mark(F.col("match_snippet")))
    return F.concat(head, rest, F.coalesce(F.concat(F.lit("\n  warning="), "parse_warning"), F.lit("")))


def detail_text(millis: bool = True) -> Column:
    """All fields of a session, a line each; times as rfc3339 has them."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    fields = [
        ("ID", F.col("id")), ("Provider", F.col("provider")), ("Provider Session ID", F.col("provider_session_id")), ("Title", dash(F.col("title"))), ("Summary", dash(F.col("summary"))),
        ("CWD", dash(F.col("cwd"))), ("Repo Root", dash(F.col("repo_root"))), ("Created", dash(rfc3339(F.col("created_at"), millis))), ("Updated", dash(rfc3339(F.col("updated_at"), millis))),
        ("Messages", F.coalesce(F.col("message_count"), F.lit(0)).cast("string")), ("Source Path", F.col("source_path")), ("Discovery", F.col("discovery_source")),
    ]
    warning = F.when(F.col("parse_warning") != "", F.concat(F.lit("\nParse Warning: "), "parse_warning"))
    return F.concat(F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields]), F.coalesce(warning, F.lit("")))


def session_text(max_lines: int | None = None) -> Column:
    """Facts and transcript of a session."""
    body = F.col("transcript_text") if max_lines is None else text.first_lines(F.col("transcript_text"), max_lines)
    facts = [
        ("ID", F.col("id")), ("Provider", F.col("provider")), ("Provider Session ID", F.col("provider_session_id")), ("CWD", F.coalesce("cwd", F.lit("-"))),
        ("Updated", minute(F.col("updated_at"))), ("Messages", F.coalesce(F.col("message_count"), F.lit(0)).cast("string")),
    ]
    listed = [F.concat(F.lit(f"- {k}: "), v, F.lit("\n")) for k, v in facts]
    return F.concat(F.lit("# "), F.coalesce("title", F.lit("(untitled)")), F.lit("\n\n"), *listed, F.lit("\n## Transcript\n\n"), body)


def search_line() -> Column:
    """A search result of the tool server."""
    title = F.coalesce(text.truncated(F.col("title"), 120), F.lit("(untitled)"))
    shape = "## %s [%s] (score: %d)\n- ID: %s\n- Provider: %s\n- CWD: %s\n- Updated: %s\n- Match: %s — %s\n\n"
    return F.format_string(shape, title, "provider", "score", "id", "provider", F.coalesce("cwd", F.lit("-")), minute(F.col("updated_at")), "match_source", "match_snippet")


def list_line() -> Column:
    """A listed session of the tool server."""
    title = F.coalesce(text.truncated(F.col("title"), 120), F.lit("(untitled)"))
    return F.format_string("- **%s** [%s] — %s | CWD: %s | ID: %s\n", title, "provider", minute(F.col("updated_at")), F.coalesce("cwd", F.lit("-")), "id")


def minute(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("-"))


def command_line(parts: list[str]) -> str:
    """Words of a command, those with a space in quotation marks."""
    quoted = lambda w: '"' + w.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return " ".join(quoted(w) if " " in w else w for w in parts)
