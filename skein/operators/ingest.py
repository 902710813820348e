"""Session files to sessions: decoded lines, then declarative folds over each file's lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, udfs
from ..functions.rows import once
from ..sources import files as source

FIELDS = "session_id string, cwd string, ts string, start string, role string, text string, is_meta boolean, last_prompt string"
_KINDS = pa.schema([(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.string()) for f in FIELDS.split(", ")])
NO_PREVIEW, FAILED = "(no preview available)", "(parse failed)"
ROLES = {"USER_EXPLICIT": "user", "USER": "user", "MODEL": "assistant"}


def _string(value) -> str | None:
    return value if isinstance(value, str) else None


def _get(value, *keys):
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def claude_line(v) -> dict:
    message = _get(v, "message")
    body = udfs.text_in(message) if message is not None else _string(_get(v, "content")) or ""
    prompt = _string(_get(v, "lastPrompt")) if _get(v, "type") == "last-prompt" else None
    return {
        "session_id": _string(_get(v, "sessionId")), "cwd": _string(_get(v, "cwd")), "ts": _string(_get(v, "timestamp")), "text": body, "last_prompt": prompt and prompt.strip(),
        "role": _string(_get(message, "role")) or _string(_get(v, "type")), "is_meta": _get(v, "isMeta") is True,
    }


def codex_line(v) -> dict:
    payload, kind = _get(v, "payload"), _get(v, "type")
    if kind == "session_meta":
        return {"session_id": _string(_get(payload, "id")), "cwd": _string(_get(payload, "cwd")), "start": _string(_get(payload, "timestamp"))}
    if kind == "response_item" and _get(payload, "type") == "message":
        return {"ts": _string(_get(v, "timestamp")), "role": _string(_get(payload, "role")), "text": udfs.text_in(payload)}
    return {}


def cursor_text(v) -> str:
    content = _get(v, "message", "content")
    if isinstance(content, list):
        content = "\n".join(x["text"] for x in content if _get(x, "type") == "text" and isinstance(_get(x, "text"), str))
    body = _string(content) or ""
    inner = udfs.tagged(body, "user_query")
    return (body if inner is None else inner).strip(udfs.SPACES)


def cursor_line(v) -> dict:
    return {"role": _string(_get(v, "role")), "text": cursor_text(v)}


def antigravity_line(v) -> dict:
    cwd = None
    calls = _get(v, "tool_calls")
    for call in calls if isinstance(calls, list) else []:
        cwd = cwd or _string(_get(call, "args", "Cwd")) or _string(_get(call, "args", "cwd"))
    source_of = _string(_get(v, "source"))
    return {"ts": _string(_get(v, "created_at")), "cwd": cwd, "role": ROLES.get(source_of or ""), "text": (_string(_get(v, "content")) or "").strip()}


DECODERS: dict[str, Callable[[object], dict]] = {"claude": claude_line, "codex": codex_line, "cursor": cursor_line, "antigravity": antigravity_line}


def lines_of(content: str) -> list[str]:
    parts = content.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def decoded_line(provider: str, line: str) -> dict:
    """The fields of a line; blank and broken ones have none."""
    value = udfs.json_line(line) if line.strip() else None
    return DECODERS[provider](value) if value is not None else {}


def read(files: DataFrame, range_bytes: int | None = None, counted=None) -> DataFrame:
    """The decoded lines of listed files, read in byte ranges."""
    return source.read_lines(files, decoded_line, _KINDS, FIELDS, range_bytes, counted)


def decoded(contents: DataFrame) -> DataFrame:
    """As read, of files that come with their content or the error of reading it; place numbers the lines from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = [{}, *(decoded_line(row["provider"], line) for line in lines_of(row["content"] or ""))]
                n = len(values)
                head = [pa.array([row["provider"]] * n), pa.array([row["source_path"]] * n), pa.array([row["mtime_ns"]] * n, pa.int64()), pa.array([row["size_bytes"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([row["error"]] * n, pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array([v.get(f.name) for v in values], f.type) for f in _KINDS)], names=["provider", "source_path", "mtime_ns", "size_bytes", "place", "error", *_KINDS.names])

    return contents.select("provider", "source_path", "mtime_ns", "size_bytes", "content", "error").mapInArrow(run, f"{source.PLACED}, {FIELDS}")


def messages(lines: DataFrame) -> DataFrame:
    """Lines with at timestamp, and kept: whether the line is a message of the transcript."""
    of = lambda p: F.col("provider") == p
    body = F.coalesce("text", F.lit(""))
    said = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) & (text.strip(body) != "")
    kept = F.when(of("claude"), said & ~text.skipped(body, F.col("is_meta"))).when(of("cursor"), said & text.substantive(body)).otherwise(said)
    mtime = F.timestamp_micros(F.expr("(mtime_ns - pmod(mtime_ns, 1000)) div 1000"))  # whole numbers: as a double, 18 digits of nanoseconds are rounded
    at = F.when(of("cursor"), mtime).otherwise(text.moment(F.col("ts")))
    return lines.withColumn("at", at).withColumn("kept", kept).withColumn("mtime", mtime)


def folded(rows: DataFrame) -> DataFrame:
    """One row for each file: the folds of its lines in file order."""
    n = F.col("place")
    first = lambda c, when: F.min_by(F.when(when, c), F.when(when & c.isNotNull(), n))
    last = lambda c, when: F.max_by(F.when(when, c), F.when(when & c.isNotNull(), n))
    any_line, kept = F.lit(True), F.col("kept")
    user = kept & (F.col("role") == "user") & ((F.col("provider") == "codex") | text.substantive(F.col("text")))
    timed = kept | (F.col("provider") == "antigravity")
    line = text.transcript_line(F.col("role"), F.col("at"), F.col("text"))
    prompt = F.when(text.substantive(F.col("last_prompt")), F.col("last_prompt"))
    body = F.sort_array(F.collect_list(F.when(kept, F.struct("place", line.alias("line")))))["line"]
    return rows.groupBy("provider", "source_path").agg(
        F.first("mtime_ns").alias("mtime_ns"), F.first("size_bytes").alias("size_bytes"), F.first("mtime").alias("mtime"), F.count_if((n > 0) & F.col("error").isNull()).alias("line_count"),
        F.min_by("error", F.when(F.col("error").isNotNull(), n)).alias("error"),
        last(F.col("session_id"), any_line).alias("said_id"), first(F.col("cwd"), any_line).alias("cwd"), first(text.moment(F.col("start")), any_line).alias("start"),
        first(F.col("at"), timed).alias("first_at"), last(F.col("at"), timed).alias("last_at"), first(F.col("text"), user).alias("first_user"), last(F.col("text"), user).alias("last_user"),
        last(prompt, any_line).alias("last_prompt"), F.count_if(kept).alias("message_count"), F.array_join(body, "\n\n").alias("transcript_text"),
    )


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?<=.)\.[^.]*$", "")


def _looked_up(rows: DataFrame, key: Column, name: str, find: Callable[[str], str | None]) -> DataFrame:
    """rows with a column name: what find gives for key, asked once for each distinct key."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([find(v) for v in values.to_pylist()], pa.string())

    keyed = rows.withColumn("_key", key)
    known = keyed.select("_key").where("_key is not null").distinct().withColumn(name, run("_key"))
    return keyed.join(known, "_key", "left").drop("_key")


def sessions(lines: DataFrame, threads: DataFrame, titles: DataFrame, repo_root: Callable = source.repo_root, workspace: Callable = source.workspace) -> DataFrame:
    """Decoded lines of files -> session columns, transcript_text, mtime_ns and size_bytes; a file
    with an error in any of its ranges is a session of that warning alone."""
    rows = folded(messages(lines))
    of = lambda p: F.col("provider") == p
    from_path = F.nullif(F.regexp_extract("source_path", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1), F.lit(""))
    parts = F.split("source_path", "/")
    psid = (
        F.when(of("claude"), F.coalesce("said_id", _stem())).when(of("codex"), F.coalesce("said_id", from_path, F.lit("unknown"))).when(of("cursor"), _stem())
        .otherwise(F.when(F.size(parts) > 4, F.element_at(parts, -4)).otherwise("unknown"))
    )
    rows = rows.withColumn("psid", psid)
    side = threads.toDF("psid", "t_title", "t_cwd", "t_created", "t_updated", "rollout_path", "t_first").withColumn("provider", F.lit("codex"))
    rows = rows.join(side, ["provider", "psid"], "left").join(titles.toDF("psid", "i_title").withColumn("provider", F.lit("codex")), ["provider", "psid"], "left")
    project = F.when(of("cursor"), F.element_at(F.split(F.substring_index("source_path", "/agent-transcripts/", 1), "/"), -1))
    rows = _looked_up(rows, project, "w_cwd", workspace)
    rows = rows.withColumn("cwd", F.when(of("cursor"), F.col("w_cwd")).when(of("codex"), F.coalesce("cwd", "t_cwd")).otherwise(F.col("cwd")))
    rows = _looked_up(rows, F.col("cwd"), "repo_root", repo_root)
    prompt = F.when(of("claude"), F.col("last_prompt")).when(of("antigravity"), F.col("last_user"))
    title = F.when(of("codex"), F.coalesce("t_title", "i_title", "first_user")).otherwise(F.coalesce(prompt, "last_user", "first_user"))
    first = F.when(of("codex"), F.coalesce("t_first", "first_user")).otherwise(F.col("first_user"))
    rows = once(rows, w_title=text.compact(title), w_first=text.compact(first))
    summary = text.clipped(F.col("w_first"), 180)
    shown = F.when(of("codex"), F.coalesce(F.col("last_user"), F.col("first_user"), summary)).otherwise(F.coalesce(prompt, "last_user", "first_user"))
    rows = once(rows, w_shown=text.compact(shown))
    created = F.when(of("codex"), F.coalesce(F.col("start"), F.timestamp_seconds("t_created"))).otherwise(F.col("first_at"))
    updated = F.when(of("cursor"), F.col("mtime")).when(of("codex"), F.coalesce(F.col("last_at"), F.timestamp_seconds("t_updated"))).otherwise(F.col("last_at"))
    plain = F.to_json(F.struct("line_count", F.col("source_path").alias("session_path")))
    meta = F.when(of("codex"), F.to_json(F.struct("line_count", "rollout_path", F.col("source_path").alias("session_path")), {"ignoreNullFields": "false"})).otherwise(plain)
    sound = F.col("error").isNull()
    own = lambda c, kind="string": F.when(sound, c).otherwise(F.lit(None).cast(kind))
    stem = F.when(sound, F.col("psid")).otherwise(_stem())
    moments = [own(c, "timestamp").alias(n) for n, c in (("created_at", created), ("updated_at", updated), ("last_message_at", updated))]
    return rows.select(
        F.concat_ws(":", F.col("provider"), stem).alias("id"), "provider", stem.alias("provider_session_id"), own(text.clipped(F.col("w_title"), 100)).alias("title"), own(summary).alias("summary"),
        own(F.col("cwd")).alias("cwd"), own(F.col("repo_root")).alias("repo_root"), *moments, F.when(sound, F.coalesce(text.preview_of(F.col("w_shown")), F.lit(NO_PREVIEW))).otherwise(FAILED).alias("preview_text"),
        "source_path", F.when(sound, F.col("message_count")).otherwise(0).alias("message_count"), F.concat("provider", F.lit("-v1")).alias("parse_version"), own(meta).alias("raw_metadata_json"),
        F.col("error").alias("parse_warning"), F.when(of("codex") & sound, "jsonl+sqlite").otherwise("jsonl").alias("discovery_source"), F.when(sound, F.col("transcript_text")).otherwise("").alias("transcript_text"), "mtime_ns", "size_bytes",
    )
