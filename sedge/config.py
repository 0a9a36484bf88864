"""Configuration in layers: defaults, then files from general to particular, then the environment."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

# Defaults of the engine.
DEFAULTS: dict[str, Any] = {
    "silo": "main",
    "search": {"limit": 20, "k": 10, "fusion": "rrf", "rrf_k": 60, "keyword_weight": 0.5, "vector_weight": 0.5},
    "embedding": {"key": "gemini-embedding-001", "dim": 768, "batch": 32, "calls_per_s": 8},
    "ingest": {"max_files": 10_000, "max_bytes": 20 * 1024 * 1024, "mode": "sync"},
    "storage": {"root": "data", "blob_max_bytes": 256 * 1024 * 1024},
    "rate_limit": {"keyword": [10, 20], "vector": [3, 6], "typeahead": [20, 40], "hybrid": [2, 4], "window_ms": 1000},
}


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` laid on ``base``; tables merge, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def from_environment(prefix: str, env: Mapping[str, str]) -> dict[str, Any]:
    """``PREFIX__a__b=1`` as {"a": {"b": 1}}; values are JSON where they parse as such, else text."""
    out: dict[str, Any] = {}
    for name, text in sorted(env.items()):
        if not name.startswith(f"{prefix}__"):
            continue
        *path, last = name[len(prefix) + 2 :].lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(text)
        except ValueError:
            at[last] = text
    return out


def default_files(app: str, env: Mapping[str, str]) -> list[Path]:
    home = Path(env.get("XDG_CONFIG_HOME") or Path(env.get("HOME", "/")) / ".config")
    return [Path("/etc") / app / "settings.toml", home / app / "settings.toml", Path("config/settings.toml")]


def load(app: str = "sedge", files: Sequence[Path] | None = None, override: Path | None = None, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The merged configuration; a file named by ``override`` must exist, others may be missing."""
    env = os.environ if env is None else env
    out = dict(DEFAULTS)
    for path in [*(default_files(app, env) if files is None else files), *([override] if override else [])]:
        if path.exists() or path == override:
            out = merge(out, tomllib.loads(path.read_text()))
    return merge(out, from_environment(app.upper(), env))
