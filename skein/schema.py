"""Canonical tables, providers and query parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import types as T

PROVIDERS = ("claude", "codex", "cursor", "antigravity")

_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()


def _struct(text: str, required: str) -> T.StructType:
    kinds = {"s": _S, "t": _TS, "l": _L}
    need = set(required.split())
    return T.StructType([T.StructField(n, kinds[k], n not in need) for n, k in (x.split(":") for x in text.split())])


SESSIONS = _struct(
    "id:s provider:s provider_session_id:s title:s summary:s cwd:s repo_root:s created_at:t updated_at:t last_message_at:t "
    "preview_text:s source_path:s message_count:l parse_version:s raw_metadata_json:s parse_warning:s discovery_source:s",
    "id provider provider_session_id preview_text source_path parse_version discovery_source",
)
TRANSCRIPTS = _struct("session_id:s transcript_text:s", "session_id transcript_text")
FILES_SEEN = _struct("provider:s source_path:s mtime_ns:l size_bytes:l last_indexed_at:t content_hash:s", "provider source_path mtime_ns size_bytes last_indexed_at")
MESSAGES = _struct("session_id:s seq:l role:s text:s ts:t", "session_id seq")


def provider(name: str) -> str:
    """The canonical name of a provider, given in any case."""
    found = name.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    if found not in PROVIDERS:
        raise ValueError(f"unsupported provider: {name}")
    return found


@dataclass(frozen=True)
class Filters:
    provider: str | None = None
    path_prefix: str | None = None
    since: dt.datetime | None = None
    limit: int = 25
    warnings_only: bool = False
