"""User settings: ``rowsift/config.toml`` in the XDG configuration folder."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

AUTO_LIMIT = 20


@dataclass(frozen=True)
class Settings:
    """``default_limit`` is for terminals, 0 for none."""

    default_fmt: str | None = None
    default_limit: int | None = None
    no_color: bool | None = None
    default_time_field: str | None = None


_KINDS = {"default_fmt": str, "default_limit": int, "no_color": bool, "default_time_field": str}


def path_of() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME") or Path(os.environ.get("HOME", "")) / ".config"
    return Path(base) / "rowsift" / "config.toml"


def load(path: Path | None = None) -> Settings:
    """The settings; a file that is absent or broken, or has a value of another kind, counts as none."""
    try:
        found = tomllib.loads((path or path_of()).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Settings()
    known = {k: v for k, v in found.items() if k in _KINDS}
    if any(type(v) is not _KINDS[k] for k, v in known.items()) or known.get("default_limit", 0) < 0:
        return Settings()
    return Settings(**known)


def show(path: Path | None = None) -> str:
    at = path or path_of()
    now = load(at)
    rows = [f"{f.name:<20} {'(unset)' if getattr(now, f.name) is None else getattr(now, f.name)}" for f in fields(Settings)]
    return "\n".join([f"settings in {at}" + ("" if at.exists() else " (no such file)"), *rows])


def reset(path: Path | None = None) -> str:
    at = path or path_of()
    if not at.exists():
        return f"nothing to reset: {at} does not exist"
    at.unlink()
    return f"removed {at}"
