"""The user's global git ignore file, which also hides files from discovery."""

from __future__ import annotations

import os
import re
from pathlib import Path


def global_patterns() -> list[str]:
    """Lines of the file that git's core.excludesFile names, or of its default place; none if missing."""
    home = Path.home()
    place = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "git" / "ignore"
    try:
        section = ""
        for line in (home / ".gitconfig").read_text(errors="replace").splitlines():
            if m := re.match(r"\s*\[([^\]]*)\]", line):
                section = m[1].strip().lower()
            elif section == "core" and (m := re.match(r"\s*excludesfile\s*=\s*(.*?)\s*$", line, re.I)):
                named = m[1].strip('"')
                place = home / named[2:] if named.startswith("~/") else Path(named)
    except OSError:
        pass
    try:
        return place.read_text(errors="replace").splitlines()
    except OSError:
        return []


def _expression(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.+", k + 3
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            inside = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return out


class Ignores:
    """Whether paths, relative to where a walk began, are ignored: the last pattern that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            again = line.startswith("!")
            glob = line[again:]
            folders = glob.endswith("/")
            glob = glob.rstrip("/")
            anchored = "/" in glob
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + _expression(glob.lstrip("/")) + r"\Z", re.S), folders, not again))

    def __call__(self, path: str, folder: bool) -> bool:
        verdict = False
        for pattern, folders, hides in self.rules:
            if (folder or not folders) and pattern.match(path):
                verdict = hides
        return verdict
