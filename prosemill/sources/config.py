"""Preferences: defaults, the project's file and the caller's overrides."""

from __future__ import annotations

import dataclasses
import json
import os

from ..functions.globs import expanded
from ..operators.policy import DEFAULT_INCLUDE

MOST_CONFIG_BYTES = 65_536


@dataclasses.dataclass(frozen=True)
class Preferences:
    dialect: str = "en-US"
    include: tuple[str, ...] = tuple(DEFAULT_INCLUDE)
    exclude: tuple[str, ...] = ()
    include_hidden: bool = False
    glossary: tuple[str, ...] = ()

    def __post_init__(self):
        if self.dialect not in ("en-US", "en-GB"):
            raise ValueError("invalid_dialect")
        if max(len(self.include), len(self.exclude)) > 128 or len(self.glossary) > 256 or any(not 1 <= len(t) <= 256 for t in self.glossary):
            raise ValueError("too_many_or_long_entries")
        for glob in (*self.include, *self.exclude):
            expanded(glob)


def merged(project: dict, overrides: dict) -> Preferences:
    """Overrides win, but for exclude and glossary, which are added up: an exclusion of the project stays."""
    known = {f.name for f in dataclasses.fields(Preferences)}
    if unknown := (set(project) | set(overrides)) - known:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    values = {**project, **{k: v for k, v in overrides.items() if v is not None}}
    for k in ("exclude", "glossary"):
        values[k] = tuple(dict.fromkeys([*project.get(k, ()), *(overrides.get(k) or ())]))
    return Preferences(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(root: str, overrides: dict, name: str = ".prose.json") -> Preferences:
    path = os.path.join(root, name)
    if not os.path.exists(path):
        return merged({}, overrides)
    with open(path, "rb") as f:
        data = f.read(MOST_CONFIG_BYTES + 1)
    if len(data) > MOST_CONFIG_BYTES:
        raise ValueError("config_too_large")
    found = json.loads(data.decode("utf-8-sig"))
    if found.pop("schema_version", 2) != 2:
        raise ValueError("config_migration_required")
    return merged(found, overrides)
