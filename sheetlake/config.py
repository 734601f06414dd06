"""Settings from the environment and an optional .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

EXTRACTORS = ("none", "ollama", "anthropic")


@dataclass(frozen=True)
class Config:
    extractor: str = "none"
    model: str | None = None


def load_env(path: str | Path = ".env") -> None:
    """Set what the file names and the environment lacks. Lines are NAME=value; blank lines and those with # are passed over."""
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        name, given, value = line.strip().partition("=")
        if given and not name.startswith("#") and name.strip():
            os.environ.setdefault(name.strip(), value.strip().strip('"').strip("'"))


def read() -> Config:
    """SHEETLAKE_EXTRACTOR and SHEETLAKE_MODEL."""
    return Config(os.environ.get("SHEETLAKE_EXTRACTOR", "").strip().lower() or "none", os.environ.get("SHEETLAKE_MODEL", "").strip() or None)


def think(value: str | None) -> bool | str | None:
    """A model's thinking setting: true and false as such, levels as they are."""
    return {"true": True, "false": False}.get(value or "", value)
