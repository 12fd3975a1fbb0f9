"""The library's configuration file (TOML), read on the driver.

It is looked for at the given path, at ``$METERLIGHT_CONFIG``, then at ``~/.config/meterlight/config.toml``;
without a file the defaults hold. Keys that are not known are errors.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

VARIABLE = "METERLIGHT_CONFIG"
DEFAULT_REGION = "us-east-1"
DEFAULT_ROOT = "~/.claude/projects"


class UnknownKey(ValueError):
    """The file has a key that this library does not read."""


@dataclass
class Ingest:
    claude_code_roots: list[str] | None = None
    claude_code_root: str | None = None
    store_raw: bool = False
    scan_interval_seconds: int = 60


@dataclass
class Inference:
    default_inference_region: str | None = None


@dataclass
class File:
    file: str | None = None


@dataclass
class Storage:
    folder: str = "~/.local/share/meterlight"


@dataclass
class Config:
    ingest: Ingest = field(default_factory=Ingest)
    inference: Inference = field(default_factory=Inference)
    pricing: File = field(default_factory=File)
    factors: File = field(default_factory=File)
    storage: Storage = field(default_factory=Storage)
    default_inference_region: str | None = None

    @property
    def region(self) -> str:
        return self.inference.default_inference_region or self.default_inference_region or DEFAULT_REGION

    @property
    def roots(self) -> list[str]:
        """The list of roots, else the single one, else the default; an empty list means the default."""
        one = [self.ingest.claude_code_root] if self.ingest.claude_code_root else []
        given = [DEFAULT_ROOT] if self.ingest.claude_code_roots == [] else self.ingest.claude_code_roots or one or [DEFAULT_ROOT]
        return [expand(r) for r in given]


def expand(path: str) -> str:
    """A leading ``~`` is the home directory."""
    return str(Path.home()) + path[1:] if path == "~" or path.startswith("~/") else path


def find(path: str | None = None) -> Path:
    return Path(path or os.environ.get(VARIABLE) or expand("~/.config/meterlight/config.toml"))


def _fill(target, values: dict, where: str):
    names = {f.name for f in fields(target)}
    for key, value in values.items():
        if key not in names:
            raise UnknownKey(f"{where}{key}")
        current = getattr(target, key)
        setattr(target, key, _fill(current, value, f"{key}.") if hasattr(current, "__dataclass_fields__") else value)
    return target


def load(path: str | None = None) -> Config:
    place = find(path)
    return _fill(Config(), tomllib.loads(place.read_text()) if place.exists() else {}, "")
