"""Settings: defaults, then the user's file, then the tree's own, then the environment, then the profile."""

from __future__ import annotations

import json
import os
import re
import tomllib
from typing import Any

DEFAULTS: dict[str, Any] = {
    "scan": {"include": [], "exclude": [], "max_bytes": 50 << 20, "tests": False, "docs": False, "hidden": False, "gitignore": True, "default_ignores": True},
    "output": {"format": "xml", "model": "claude", "max_tokens": None, "line_numbers": True, "compression": "none"},
    "security": {"scan": True, "redact": False, "allow": []},
}
#: In the order in which they are looked for.
NAMES = (".tesserinerc", ".tesserine.yaml", ".tesserine.yml", ".tesserine.toml", ".tesserine.json", "tesserine.yaml", "tesserine.toml", "tesserine.json")
IGNORE_FILE = ".tesserineignore"


def _scalar(s: str) -> Any:
    s = s.strip()
    if s in ("", "~", "null"):
        return None
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in re.findall(r'"[^"]*"|\'[^\']*\'|[^,\[\]\s][^,\[\]]*', s[1:-1])]
    if s[0] in "\"'" and s[-1] == s[0] and len(s) > 1:
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    return int(s) if re.fullmatch(r"-?\d+", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s


def parse_yaml(text: str) -> dict[str, Any]:
    """The part of YAML that settings need: nested maps, lists of scalars (also in brackets), scalars, comments."""
    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(i: int, indent: int) -> tuple[Any, int]:
        if i < len(lines) and lines[i][1].startswith("- "):
            out: list[Any] = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                out.append(_scalar(lines[i][1][2:]))
                i += 1
            return out, i
        found: dict[str, Any] = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            key, sep, rest = lines[i][1].partition(":")
            if not sep:
                raise ValueError(f"not a setting: {lines[i][1]}")
            i += 1
            if rest.strip():
                found[key.strip().strip("\"'")] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or (lines[i][0] == indent and lines[i][1].startswith("- "))):
                found[key.strip().strip("\"'")], i = block(i, lines[i][0])
            else:
                found[key.strip().strip("\"'")] = None
        return found, i

    out, end = block(0, lines[0][0]) if lines else ({}, 0)
    if end < len(lines) or not isinstance(out, dict):
        raise ValueError(f"not a setting: {lines[end][1] if end < len(lines) else text}")
    return out


def parse(text: str, name: str) -> dict[str, Any]:
    kind = os.path.splitext(name)[1].lstrip(".")
    if kind not in ("json", "toml", "yaml", "yml"):  # an rc file: told by its looks
        kind = "json" if text.lstrip().startswith("{") else "toml" if re.search(r"^\s*\[[\w.]+\]\s*$|^\s*\w+\s*=", text, re.MULTILINE) else "yaml"
    return json.loads(text) if kind == "json" else tomllib.loads(text) if kind == "toml" else parse_yaml(text)


def merge(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def from_environment(env: dict[str, str], prefix: str = "TESSERINE_") -> dict[str, Any]:
    """PREFIX_SECTION__KEY=value; values are JSON where they parse as such."""
    out: dict[str, Any] = {}
    for k, v in env.items():
        if k.startswith(prefix) and "__" in k:
            section, key = k.removeprefix(prefix).lower().split("__", 1)
            try:
                out.setdefault(section, {})[key] = json.loads(v)
            except ValueError:
                out.setdefault(section, {})[key] = v
    return out


def _read(at: str) -> dict[str, Any]:
    with open(at, encoding="utf-8") as f:
        return parse(f.read(), at)


def ignore_patterns(root: str) -> list[str]:
    """Globs of the tree's own ignore file, one a line; blank lines and comments left out."""
    at = os.path.join(root, IGNORE_FILE)
    if not os.path.isfile(at):
        return []
    with open(at, encoding="utf-8") as f:
        return [x for x in (line.strip() for line in f) if x and not x.startswith("#")]


def load(root: str = ".", profile: str | None = None, env: dict[str, str] | None = None, at: str | None = None, user: str | None = None) -> dict[str, Any]:
    """The tree's own file (the first of ``NAMES``) overrides the user's; ``at`` names another in its place,
    and then the tree's ignore file isn't read either.  Lists ``ignore`` and ``exclude`` at the top are patterns to leave out."""
    out = DEFAULTS
    home = os.path.expanduser("~/.config/tesserine") if user is None else user
    theirs = next((p for n in ("config.yaml", "config.toml") if os.path.isfile(p := os.path.join(home, n))), None)
    own = at or next((p for n in NAMES if os.path.isfile(p := os.path.join(root, n))), None)
    for name in (theirs, own):
        if name:
            out = merge(out, _read(name))
    out = merge(out, from_environment(dict(os.environ) if env is None else env))
    if profile:
        if profile not in out.get("profiles", {}):
            raise ValueError(f"no profile {profile}")
        out = merge(out, out["profiles"][profile])
    more = [x for k in ("ignore", "exclude") for x in (out.get(k) or []) if isinstance(out.get(k), list)]
    more += [] if at else ignore_patterns(root)
    return merge(out, {"scan": {"exclude": list(dict.fromkeys([*out["scan"]["exclude"], *more]))}})


def render(kind: str = "json") -> str:
    """The defaults as a file of one's own to begin with."""
    plain = {s: {k: v for k, v in d.items() if v is not None} for s, d in DEFAULTS.items()}
    if kind == "json":
        return json.dumps(plain, indent=2) + "\n"
    if kind == "toml":
        return "\n".join(f"[{s}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in d.items()) for s, d in plain.items())
    return "".join(f"{s}:\n" + "".join(f"  {k}: {json.dumps(v)}\n" for k, v in d.items()) for s, d in plain.items())
