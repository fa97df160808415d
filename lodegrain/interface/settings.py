"""Keys from .env files, nearby indexes and model names."""

from __future__ import annotations

import difflib
import os
from collections.abc import Iterable, Sequence
from pathlib import Path

INDEX_DIR = ".lodegrain"


def read_env(paths: Iterable[str | Path]) -> dict[str, str]:
    """KEY=value lines of all files; the first that sets a key wins.  Comments and quotes are dropped."""
    found: dict[str, str] = {}
    for path in map(Path, paths):
        for line in path.read_text().splitlines() if path.is_file() else ():
            key, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not key.startswith("#"):
                found.setdefault(key.strip(), value.strip().strip("\"'"))
    return found


def load_env(paths: Iterable[str | Path]) -> None:
    for k, v in read_env(paths).items():
        os.environ.setdefault(k, v)


def nearby_index(folder: str | Path, up: int = 2) -> Path | None:
    """The index of a folder or of one up to ``up`` levels above."""
    at = Path(folder).resolve()
    for place in [at, *list(at.parents)[:up]]:
        if (place / INDEX_DIR).is_dir():
            return place / INDEX_DIR
    return None


def resolve_model(wanted: str, available: Sequence[str]) -> str | None:
    """The available model meant by a name: equal, then with the same base, then beginning so, then close to it."""
    name = wanted.strip().lower()
    lower = {a.lower(): a for a in available}
    if not name or not lower:
        return None
    base = name.split(":")[0]
    for test in (lambda a: a == name, lambda a: a.split(":")[0] == base and ":" not in name, lambda a: a.startswith(name)):
        if hit := sorted(a for a in lower if test(a)):
            return lower[hit[0]]
    close = difflib.get_close_matches(name, lower, 1, 0.75)
    return lower[close[0]] if close else None


def choose_embedding_model(available: Sequence[str], profile: str = "precision") -> str | None:
    """The first available model of a profile's order."""
    order = {"precision": ("minilm", "granite", "bge", "nomic"), "conceptual": ("nomic", "bge", "granite", "minilm")}[profile]
    return next((a for part in order for a in sorted(available) if part in a.lower()), None)
