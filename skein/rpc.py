"""Tool server: JSON-RPC lines on standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from .api import Engine, current_repo
from .schema import PROVIDERS, Filters, provider
from .streaming.refresh import Refresher

_TEXT, _COUNT = {"type": "string"}, {"type": "integer"}
_PROVIDER = _TEXT | {"enum": list(PROVIDERS)}


def _tool(name: str, about: str, required: list[str], **properties) -> dict:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, **({"required": required} if required else {})}}


TOOLS = [
    _tool("search_sessions", "Ranked search over all indexed sessions.", ["query"], query=_TEXT, provider=_PROVIDER, limit=_COUNT | {"default": 10}),
    _tool("get_session", "Facts and transcript of the session with an id or the start of one.", ["session_id"], session_id=_TEXT, max_lines=_COUNT),
    _tool("list_sessions", "The last updated sessions.", [], provider=_PROVIDER, path_prefix=_TEXT, limit=_COUNT | {"default": 20}),
    _tool("get_resume_command", "The command that resumes a session in its own tool.", ["session_id"], session_id=_TEXT),
]


def _count(args: dict, name: str, default: int | None) -> int | None:
    value = args.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


def _needed(args: dict, name: str) -> str:
    if not isinstance(args.get(name), str):
        raise ValueError(f"missing required parameter: {name}")
    return args[name]


def _provider(args: dict) -> str | None:
    return provider(args["provider"]) if isinstance(args.get("provider"), str) else None


class Server:
    def __init__(self, engine: Engine, refresh: Callable[[], None] | None = None):
        self.engine, self.refresh = engine, refresh or Refresher(engine.reindex)

    def call(self, name: str, args: dict) -> str:
        e = self.engine
        if name == "search_sessions":
            return e.search_text(_needed(args, "query"), Filters(provider=_provider(args), limit=_count(args, "limit", 10)), current_repo(e.config))
        if name == "get_session":
            return e.session_text(_needed(args, "session_id"), _count(args, "max_lines", None))
        if name == "list_sessions":
            prefix = args.get("path_prefix")
            return e.list_text(Filters(provider=_provider(args), path_prefix=prefix if isinstance(prefix, str) else None, limit=_count(args, "limit", 20)))
        if name == "get_resume_command":
            return e.resume_command(_needed(args, "session_id"))
        raise ValueError(f"unknown tool: {name}")

    def answer(self, line: str) -> str | None:
        """The response to one line; None for notifications and for lines that are no request."""
        try:
            request = json.loads(line)
        except ValueError:
            return None
        if not isinstance(request, dict) or "id" not in request:
            return None
        method, params = request.get("method"), request.get("params") or {}
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            reply["result"] = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "skein", "version": "0.1.0"}}
        elif method == "tools/list":
            reply["result"] = {"tools": TOOLS}
        elif method == "ping":
            reply["result"] = {}
        elif method == "tools/call":
            self.refresh()
            try:
                reply["result"] = {"content": [{"type": "text", "text": self.call(params.get("name", ""), params.get("arguments") or {})}]}
            except (ValueError, LookupError) as e:
                reply["result"] = {"isError": True, "content": [{"type": "text", "text": str(e)}]}
        else:
            reply["error"] = {"code": -32601, "message": f"method not found: {method}"}
        return json.dumps(reply)

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        self.refresh()
        for line in lines:
            if line.strip() and (reply := self.answer(line)) is not None:
                print(reply, file=out, flush=True)
