"""Functions that need bytes, recursion or a search per value: Arrow-batched, with plain Python models."""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LOWER, UPPER

_ASCII = str.maketrans(UPPER, LOWER)
#: Unicode's white space. Python's own has the separators U+001C to U+001F besides, which are text to the SQL and to `text.strip`.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def compact(value: str) -> str:
    return " ".join(value.split())


def truncate(value: str, n: int) -> str:
    """Compact text within n bytes, `...` included."""
    raw = compact(value).encode()
    if len(raw) <= n:
        return raw.decode()
    return raw[: max(0, n - 3)].decode(errors="ignore") + "..."


def snippet_of(value: str | None, query: str, n: int = 160) -> str:
    """The surroundings of the whole query, else of its first word that occurs, else the start."""
    body = compact(value or "")
    if not body:
        return "(no snippet available)"
    raw, low = body.encode(), body.translate(_ASCII).encode()
    wanted = query.translate(_ASCII)
    for piece in (wanted, *wanted.split()):
        key = piece.encode()
        at = low.find(key)
        if at < 0:
            continue
        start, end = max(0, at - n // 2), min(len(raw), at + len(key) + n // 2)
        while start > 0 and raw[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return "..." * (start > 0) + raw[start:end].decode() + "..." * (end < len(raw))
    return truncate(body, n)


_HEADER = re.compile(r"\[[^\]]*\](.*)\Z", re.S)


def turns_of(transcript: str | None) -> list[tuple[str, str]]:
    """(role, body) of each turn; what stands before the first header is left out."""
    out: list[tuple[str, list[str]]] = []
    for line in _lines(transcript or ""):
        m = _HEADER.match(line)
        role = m[1].strip() if m else ""
        if role in ("user", "assistant"):
            out.append((role, []))
        elif out:
            out[-1][1].append(line)
    return [(role, "\n".join(body).strip("\n")) for role, body in out]


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def body_head(body: str, n: int) -> str:
    own = body.rstrip()
    lines = _lines(own)
    if not own:
        return "(empty)"
    return own if len(lines) <= n else "\n".join(lines[:n]) + "\n  […]"


def summary_of(transcript: str | None) -> str:
    """First and final prompt and reply of a transcript, with marks for the turns between."""
    turns = turns_of(transcript)
    if not turns:
        return "(no transcript content)"
    at = {role: [k for k, (r, _) in enumerate(turns) if r == role] for role in ("user", "assistant")}
    chosen: dict[int, tuple[str, int]] = {}
    for role, end, label, n in (("user", 0, "First prompt", 8), ("assistant", 0, "First reply", 4), ("user", -1, "Final prompt", 8), ("assistant", -1, "Final reply", 14)):
        if at[role]:
            chosen.setdefault(at[role][end], (label, n))
    plural = lambda n: f"{n} {{}}turn{'' if n == 1 else 's'}"
    parts, before = [], None
    for k in sorted(chosen):
        if before is not None and k > before + 1:
            parts.append(f"⋯ {plural(k - before - 1).format('more ')} hidden ⋯")
        label, n = chosen[k]
        parts += [f"── {label} ──", body_head(turns[k][1], n)]
        before = k
    return "\n\n".join([*parts, f"({plural(len(turns)).format('')} total)"])


def text_in(value) -> str:
    """All text of a JSON value: strings, items of lists, and of objects a string `text` and what
    is under content, message, input and output, in this order."""
    found: list[str] = []

    def walk(v) -> None:
        if isinstance(v, str):
            if v.strip():
                found.append(v.strip())
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, dict):
            if isinstance(v.get("text"), str):
                walk(v["text"])
            for key in ("content", "message", "input", "output"):
                if key in v:
                    walk(v[key])

    walk(value)
    return "\n".join(found)


def json_line(line: str):
    """A JSON value of strict syntax, or None."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(line, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def tagged(body: str | None, tag: str) -> str | None:
    """What the first <tag> and the first </tag> after it hold, without white space around."""
    _, opened, rest = (body or "").partition(f"<{tag}>")
    inner, closed, _ = rest.partition(f"</{tag}>")
    return inner.strip(SPACES) if opened and closed else None


def _on_texts(f, kind):
    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in values.to_pylist()], {"string": pa.string(), "long": pa.int64()}[kind])

    return run


def summary(c: Column | str) -> Column:
    return _on_texts(summary_of, "string")(c)


def snippet(c: Column, query: str, n: int = 160) -> Column:
    return _on_texts(functools.partial(snippet_of, query=query, n=n), "string")(c)


def between_tags(c: Column, tag: str) -> Column:
    return _on_texts(functools.partial(tagged, tag=tag), "string")(c)


def turns(c: Column) -> Column:
    @F.arrow_udf("array<struct<role:string,body:string>>")
    def run(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("role", pa.string()), ("body", pa.string())]))
        return pa.array([[{"role": r, "body": b} for r, b in turns_of(v)] for v in values.to_pylist()], kind)

    return run(c)
