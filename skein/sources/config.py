"""Configuration: a TOML file with defaults, and the paths it names."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..schema import PROVIDERS

#: Where the tools keep their sessions, below the home directory.
DEFAULT_ROOTS = {"claude": ".claude/projects", "codex": ".codex/sessions", "cursor": ".cursor/projects", "antigravity": ".gemini/antigravity/brain"}


def expand(path: str) -> str:
    """A path with a leading ~/ resolved."""
    return str(Path.home() / path[2:]) if path.startswith("~/") else path


@dataclass
class Config:
    roots: dict[str, list[str]] = field(default_factory=lambda: {p: [str(Path.home() / d)] for p, d in DEFAULT_ROOTS.items()})
    enabled: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(PROVIDERS, True))
    store: str = field(default_factory=lambda: expand("~/.local/share/skein/store"))
    cache: str = field(default_factory=lambda: expand("~/.cache/skein"))
    codex_home: str = field(default_factory=lambda: expand("~/.codex"))
    default_limit: int = 50
    prefer_current_repo: bool = True
    preview_lines: int = 12

    @staticmethod
    def path() -> Path:
        return Path.home() / ".config/skein/config.toml"

    @classmethod
    def load(cls, path: str | Path | None = None) -> Config:
        """Defaults for a missing file and for what it leaves out; a file that is no TOML raises."""
        own, path = cls(), Path(path or cls.path())
        if not path.exists():
            return own
        data = tomllib.loads(path.read_text())
        for p, section in data.get("providers", {}).items():
            if p in own.roots:
                own.enabled[p] = section.get("enabled", True)
                if section.get("paths"):
                    own.roots[p] = [expand(x) for x in section["paths"]]
        index, search, ui = (data.get(section, {}) for section in ("index", "search", "ui"))
        own.store = expand(index.get("db_path", own.store))
        own.cache = expand(index.get("cache_dir", own.cache))
        own.default_limit = search.get("default_limit", own.default_limit)
        own.preview_lines = ui.get("preview_lines", own.preview_lines)
        own.prefer_current_repo = search.get("prefer_current_repo", own.prefer_current_repo)
        return own

    def all_roots(self) -> list[tuple[str, str]]:
        return [(p, root) for p in PROVIDERS if self.enabled[p] for root in self.roots[p]]
