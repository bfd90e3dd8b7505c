"""Settings from TOML, checked; nothing here runs on Spark."""

from __future__ import annotations

import os
import tempfile
import tomllib
from dataclasses import dataclass, field, fields

from ..functions.chunking import Limits
from ..functions.globs import EXCLUDE, INCLUDE
from .search import Settings

SCAN_INTERVALS = (300, 600, 1800)


@dataclass(frozen=True)
class Config:
    """One catalog's settings; see the defaults of each part."""

    scan_interval: int = 300
    stable_seconds: int = 30
    confirmations: int = 2
    metric: str = "cosine"
    dimensions: int = 64
    limits: Limits = field(default_factory=Limits)
    search: Settings = field(default_factory=Settings)
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE

    def __post_init__(self) -> None:
        if self.scan_interval not in SCAN_INTERVALS:
            raise ValueError(f"scan_interval must be one of {SCAN_INTERVALS}")
        if self.metric not in ("cosine", "l2", "dot"):
            raise ValueError("metric must be cosine, l2 or dot")
        for name in ("stable_seconds", "confirmations", "dimensions"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")


def parse(text: str) -> Config:
    """A config from TOML with the tables knowledge, chunks and search; unknown keys are errors."""
    data = tomllib.loads(text)
    parts = {"chunks": (Limits, "limits"), "search": (Settings, "search")}
    top = dict(data.pop("knowledge", {}))
    for table, (kind, name) in parts.items():
        if table in data:
            top[name] = kind(**data.pop(table))
    strange = sorted(set(data) | set(top) - {f.name for f in fields(Config)})
    if strange:
        raise ValueError("unknown settings: " + ", ".join(strange))
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in top.items()})


def load_env(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and quotes are taken off."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name.strip().isidentifier():
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def write_atomically(path: str, text: str) -> None:
    """A whole file or none: written beside its place, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, name = tempfile.mkstemp(dir=folder, prefix=".new-")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)
