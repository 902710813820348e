"""Files in a temporary directory through discovery, parsing, the store, search and the front ends."""

import datetime as dt
import io
import json
import os
import sqlite3
import time

import pytest

from skein import cli, rpc
from skein.api import Engine, parse_since
from skein.functions import udfs
from skein.operators import render, store
from skein.schema import Filters, provider
from skein.sources import files, ignores
from skein.sources.config import Config
from skein.streaming.refresh import Refresher

CODEX_ID = "0a1b2c3d-1111-2222-3333-444455556666"


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def say(role, body, at=None, **more):
    return {"sessionId": "s1", "type": role, "timestamp": at, "cwd": "/w", "message": {"role": role, "content": body}, **more}


@pytest.fixture
def home(tmp_path):
    c = tmp_path / "claude"
    write(
        c / "p" / "s1.jsonl",
        say("user", "Fix the parser", "2024-01-01T10:00:00Z"),
        "not json", "",
        say("user", "<local-command-caveat> x", "2024-01-01T10:30:00Z", isMeta=True),
        say("assistant", [{"type": "text", "text": "Done"}, {"type": "tool_use", "input": {"command": "ls"}}], "2024-01-01T12:00:00Z"),
        say("user", "<command-name>/exit</command-name>", "2024-01-01T13:00:00Z"),
        say("user", "Thanks a lot", "2024-01-01T11:00:00Z"),
        {"type": "last-prompt", "lastPrompt": "  Final prompt words "},
    )
    write(c / "p" / "subagents" / "x.jsonl", say("user", "hidden"))
    write(c / "memory" / "y.jsonl", say("user", "hidden"))
    (c / "p" / "bad.jsonl").write_bytes(b"\xff\xfe{}")
    (c / "p" / "dir.jsonl").mkdir()
    x = tmp_path / "codex"
    write(
        x / "2024" / f"rollout-{CODEX_ID}.jsonl",
        {"type": "session_meta", "payload": {"id": CODEX_ID, "cwd": "/c", "timestamp": "2024-02-01T00:00:00Z"}},
        {"type": "response_item", "timestamp": "2024-02-01T01:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"text": "Codex question"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "f"}},
        {"type": "response_item", "timestamp": None, "payload": {"type": "message", "role": "assistant", "content": [{"text": "Codex answer"}]}},
    )
    ch = tmp_path / "codexhome"
    ch.mkdir()
    db = sqlite3.connect(ch / "state_5.sqlite")
    db.execute("create table threads (id text, title text, cwd text, created_at int, updated_at int, rollout_path text, first_user_message text)")
    db.execute("insert into threads values (?, 'Side title', '/side', 1, 2, '/r', 'Side first')", (CODEX_ID,))
    db.commit()
    db.close()
    (ch / "session_index.jsonl").write_text('{"id":"q","thread_name":"a"}\nbad\n{"id":"q","thread_name":"b"}\n')
    u = tmp_path / "cursor"
    write(
        u / "empty-window" / "agent-transcripts" / "k" / "k.jsonl",
        {"role": "user", "message": {"content": [{"type": "text", "text": "x <user_query> Ask it </user_query>"}, {"type": "tool_use", "text": "no"}]}},
        {"role": "assistant", "message": {"content": "Reply"}},
        {"role": "user", "message": {"content": "Ask again"}},
    )
    write(u / "empty-window" / "agent-transcripts" / "k" / "subagents" / "z.jsonl", {"role": "user", "message": {"content": "no"}})
    write(u / "elsewhere" / "w.jsonl", {"role": "user", "message": {"content": "no"}})
    g = tmp_path / "gem"
    write(
        g / "conv9" / ".system_generated" / "logs" / "transcript.jsonl",
        {"source": "USER_EXPLICIT", "created_at": "2024-03-01T00:00:00Z", "content": " Build it ", "tool_calls": [{"args": {"Cwd": "/g"}}]},
        {"source": "MODEL", "created_at": "2024-03-01T00:01:00Z", "content": "Built"},
        {"source": "SYSTEM", "created_at": "2024-03-01T00:02:00Z", "content": "noise"},
    )
    roots = {"claude": [str(c)], "codex": [str(x)], "cursor": [str(u)], "antigravity": [str(g), str(tmp_path / "missing")]}
    return Config(roots=roots, store=str(tmp_path / "store"), cache=str(tmp_path / "cache"), codex_home=str(ch))


def rows_of(engine):
    return {r["id"]: r for r in engine.store.rows().collect()}


def test_ingest_search_and_refresh(spark, home):
    e = Engine(spark, home)
    assert e.reindex() == (6, 6)
    r = rows_of(e)
    assert set(r) == {"claude:s1", "claude:bad", "claude:dir", f"codex:{CODEX_ID}", "cursor:k", "antigravity:conv9"}
    s = r["claude:s1"]
    assert (s["title"], s["summary"], s["message_count"], s["cwd"]) == ("Final prompt words", "Fix the parser", 3, "/w")
    assert s["created_at"] == dt.datetime(2024, 1, 1, 10) and s["updated_at"] == dt.datetime(2024, 1, 1, 11)  # the last in the file, not the latest
    assert s["transcript_text"] == "[2024-01-01 10:00:00 UTC] user\nFix the parser\n\n[2024-01-01 12:00:00 UTC] assistant\nDone\n\n[2024-01-01 11:00:00 UTC] user\nThanks a lot"
    assert json.loads(s["raw_metadata_json"])["line_count"] == 8
    assert r["claude:bad"]["parse_warning"] and r["claude:dir"]["parse_warning"] and r["claude:bad"]["preview_text"] == "(parse failed)"
    x = r[f"codex:{CODEX_ID}"]
    assert (x["title"], x["summary"], x["cwd"], x["preview_text"]) == ("Side title", "Side first", "/c", "Codex question")
    assert x["updated_at"] == dt.datetime(2024, 2, 1, 1) and "unknown-time" in x["transcript_text"] and json.loads(x["raw_metadata_json"])["rollout_path"] == "/r"
    k = r["cursor:k"]
    assert (k["title"], k["summary"], k["message_count"], k["cwd"]) == ("Ask again", "Ask it", 3, None) and k["updated_at"] == k["created_at"]
    a = r["antigravity:conv9"]
    assert (a["title"], a["cwd"], a["message_count"]) == ("Build it", "/g", 2) and a["updated_at"] == dt.datetime(2024, 3, 1, 0, 2)

    assert e.reindex() == (6, 0)
    path = os.path.join(home.roots["claude"][0], "p", "s1.jsonl")
    with open(path, "a") as f:
        f.write(json.dumps(say("user", "One more zebra", "2024-01-02T00:00:00Z")) + "\n")
    os.unlink(os.path.join(home.roots["cursor"][0], "empty-window", "agent-transcripts", "k", "k.jsonl"))
    assert e.reindex() == (5, 1)
    assert rows_of(e)["claude:s1"]["message_count"] == 4 and "cursor:k" in rows_of(e)  # deleted files stay
    at = "2024-03-05 00:00:00"
    hits = e.search("zebra", Filters(limit=5), as_of=at).collect()
    assert [h["id"] for h in hits] == ["claude:s1"] and "zebra" in hits[0]["match_snippet"] and hits[0]["match_source"] == "transcript"
    assert e.search("zebra", Filters(provider="codex", limit=5), as_of=at).collect() == []  # candidates come before filters
    assert [h["id"] for h in e.search("codex-question", Filters(limit=5), as_of=at).collect()] == [f"codex:{CODEX_ID}"]  # a phrase
    assert [h["id"] for h in e.search("qqqq", Filters(limit=2), as_of=at).collect()] == ["cursor:k", "antigravity:conv9"]  # nothing found: recent ones
    assert [x["id"] for x in e.list_recent(Filters(limit=1)).collect()] == ["cursor:k"]
    assert {x["provider"]: x["n"] for x in e.counts_by_provider().collect()} == {"claude": 3, "codex": 1, "cursor": 1, "antigravity": 1} and e.parse_warnings() == 2
    with pytest.raises(LookupError, match="ambiguous"):
        e.resolve("claude:")
    with pytest.raises(LookupError, match="no session matches"):
        e.resolve("nothing")
    assert e.resolve("ANTIGRAVITY:c")["id"] == "antigravity:conv9"
    assert e.export("claude:s1").startswith("# Final prompt words\n\n- Provider: claude\n") and json.loads(e.export("claude:s1", "json"))["updated_at"] == "2024-01-02T00:00:00Z"
    with pytest.raises(ValueError, match="unsupported export format"):
        e.export("claude:s1", "pdf")
    assert "First prompt" in e.preview("claude:s1")
    with pytest.raises(ValueError, match="not supported"):
        e.resume_command("cursor:k")

    server = rpc.Server(e, lambda: None)
    ask = lambda method, **p: json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})))
    assert ask("initialize")["result"]["protocolVersion"] and len(ask("tools/list")["result"]["tools"]) == 4 and ask("ping")["result"] == {}
    assert ask("nope")["error"]["code"] == -32601 and server.answer("bad") is None and server.answer('{"method":"x"}') is None
    tool = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    assert "claude:s1" in tool("search_sessions", query="zebra")["content"][0]["text"]
    assert tool("search_sessions", query="zebra", limit=0)["content"][0]["text"].startswith("No sessions")
    assert tool("search_sessions")["isError"] and tool("list_sessions", provider="x")["isError"] and tool("other")["isError"]
    assert "cursor:k" in tool("list_sessions", limit=1)["content"][0]["text"]
    assert tool("get_session", session_id="claude:s1", max_lines=1)["content"][0]["text"].endswith("## Transcript\n\n[2024-01-01 10:00:00 UTC] user")
    out = io.StringIO()
    server.serve(io.StringIO('{"id":1,"method":"ping"}\n\n{"method":"notifications/x"}\n'), out)
    assert out.getvalue().count("\n") == 1

    os.environ["TZ"] = "America/New_York"  # times are UTC wherever the driver is
    time.tzset()
    try:
        assert "Updated: 2024-01-02T00:00:00+00:00" in e.detail_text("claude:s1") and "Created: 2024-01-01T10:00:00+00:00" in e.detail_text("claude:s1")
        assert "- Updated: 2024-01-02 00:00\n" in e.session_text("claude:s1")
    finally:
        del os.environ["TZ"]
        time.tzset()

    run = lambda *argv: cli.run(cli.parser().parse_args(argv), e)
    assert "claude:s1" in run("show", "claude:s1") and run("show", "claude:s1", "--raw").startswith("[2024-01-01")
    assert "[[zebra]]" in run("search", "zebra") and "conv9" in run("list", "--provider", "Antigravity") and "files discovered: 3" in run("doctor") and "Store:" in run("paths")
    assert run("reindex", "--full") == "5 files seen, 5 indexed" and "cursor:k" not in rows_of(e)


def test_small_pieces(tmp_path):
    assert provider("CLAUDE") == "claude"
    with pytest.raises(ValueError, match="unsupported provider"):
        provider("x")
    assert parse_since("2024-01-02") == dt.datetime(2024, 1, 2) and parse_since("2024-01-02T02:00:00+02:00") == dt.datetime(2024, 1, 2)
    for bad in ("2024", "2024-01-02T00:00:00", "x"):
        with pytest.raises(ValueError):
            parse_since(bad)
    assert udfs.tagged("a <t> b </t> c", "t") == "b" and udfs.tagged("<t> b", "t") is None and udfs.tagged("</t> <t>", "t") is None
    assert files.workspace("empty-window") is None and files.workspace("Users-x") is None
    for made in ("me/my-app/web", "me/my/app", "me/x-y-z"):
        (tmp_path / "u" / made).mkdir(parents=True)
    below = lambda name: files.workspace(name, str(tmp_path / "u"))
    assert below("Users-me-my-app-web") == str(tmp_path / "u/me/my-app/web") and below("Users-me-my-app") == str(tmp_path / "u/me/my/app")  # more slashes first
    assert below("Users-me-x-y-z") == str(tmp_path / "u/me/x-y-z") and below("Users-me-q") is None
    assert below("Users-" + "-".join("abcdefgh" * 5)) is None  # 40 dashes take no time
    assert render.command_line(["codex", "resume", 'a "b']) == 'codex resume "a \\"b"'
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a").mkdir()
    assert files.repo_root(str(tmp_path / "r" / "a")) == str(tmp_path / "r")
    (tmp_path / "c.toml").write_text('[providers.codex]\nenabled = false\n[providers.claude]\npaths = ["~/x"]\n[search]\ndefault_limit = 7\n')
    c = Config.load(tmp_path / "c.toml")
    assert c.default_limit == 7 and not c.enabled["codex"] and c.roots["claude"][0].endswith("/x") and c.roots["cursor"]
    assert Config.load(tmp_path / "none.toml").default_limit == 50


def test_global_ignores(spark, home, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "xdg"))
    assert ignores.global_patterns() == []
    (tmp_path / "xdg/git").mkdir(parents=True)
    (tmp_path / "xdg/git/ignore").write_text("bad.jsonl\n")
    assert ignores.global_patterns() == ["bad.jsonl"]
    (tmp_path / "own").write_text("# mine\n*.jsonl\n!rollout-*\nlogs/\n")
    (tmp_path / ".gitconfig").write_text("[user]\n excludesfile = /no\n[core]\n\tExcludesFile = ~/own\n")
    found = lambda *a: {r["source_path"].rsplit("/", 1)[1] for r in files.discover(spark, home.all_roots(), *a).collect()}
    assert found() == {f"rollout-{CODEX_ID}.jsonl"}
    assert found([]) == {"s1.jsonl", "bad.jsonl", "dir.jsonl", f"rollout-{CODEX_ID}.jsonl", "k.jsonl", "transcript.jsonl"}
    hides = lambda line, path, folder=False: ignores.Ignores([line])(path, folder)
    assert hides("a", "x/a") and hides("/a", "a") and not hides("/a", "x/a") and not hides("a/", "a") and hides("a/", "x/a", True)
    assert hides("x/**/a", "x/y/z/a") and hides("x/**/a", "x/a") and hides("x/**", "x/y") and not hides("x/*", "x/y/z") and hides("[!b]?c", "aac") and not hides("", "a") and not hides("#a", "#a") and hides("\\#a", "#a")


def test_layers_are_merged_and_compacted(spark, home, monkeypatch):
    monkeypatch.setattr(store, "MAX_LAYERS", 2)
    e = Engine(spark, home)
    seen = []
    assert e.reindex(progress=lambda *n: seen.append(n)) == (6, 6) and seen == [(6, 6, 6)]
    path = os.path.join(home.roots["claude"][0], "p", "s1.jsonl")
    counts = []
    for k in range(3):
        with open(path, "a") as f:
            f.write(json.dumps(say("user", f"Line {k} quagga", f"2024-01-0{k + 3}T00:00:00Z")) + "\n")
        assert e.reindex() == (6, 1)
        layers = e.store._manifest()["layers"]
        counts.append(len(layers))
        r = rows_of(e)
        assert len(r) == 6 and r["claude:s1"]["message_count"] == 4 + k
        assert e.store.table("files_seen").count() == 6 and e.store.table("transcripts").count() == 6
        assert [h["id"] for h in e.search("quagga", Filters(limit=3), as_of="2024-03-05 00:00:00").collect()] == ["claude:s1"]
        postings, lengths = e.store.index()
        assert postings.where("term = 'quagga'").select("tf").collect()[0][0] >= k + 1 and lengths.count() == 6
        assert set(os.listdir(home.store)) >= set(layers)
    assert counts == [2, 1, 2]
    before = rows_of(e)
    monkeypatch.setattr(store.ingest, "read", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.reindex(full=True)
    assert rows_of(e) == before  # a full refresh that fails leaves the index as it was


def test_refresher_waits():
    now, calls = [0.0], []
    r = Refresher(lambda: calls.append(1), clock=lambda: now[0])
    assert r() and not r()
    now[0] = 1.6
    assert r() and len(calls) == 2

    def fail():
        raise OSError("disk")

    assert Refresher(fail)()
