"""Projects and settings: small documents that the driver keeps."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from tessera.sources.files import Filters

FOLDER, MANIFEST, RECENT = ".tessera", "project.json", 10


class SettingsError(ValueError):
    """A setting that is unknown or of the wrong kind."""


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _save(path: str, data: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".part", "w") as f:
        json.dump(data, f)
    os.replace(path + ".part", path)


def _load(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


@dataclass
class Project:
    root: str
    project_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: str = field(default_factory=_now)
    last_opened_at: str | None = None
    indexed: bool = False
    filters: dict = field(default_factory=lambda: {"mode": "all"})
    stats: dict = field(default_factory=dict)

    @classmethod
    def open(cls, root: str) -> Project:
        """The project in a folder; it is made if there is none. One that was moved keeps its id."""
        root = os.path.realpath(root)
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        data = _load(os.path.join(root, FOLDER, MANIFEST))
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__}
        p = cls(**(known | {"root": root}))
        p.last_opened_at = _now()
        p.save()
        return p

    @property
    def store(self) -> str:
        return os.path.join(self.root, FOLDER, "graph")

    def save(self) -> None:
        _save(os.path.join(self.root, FOLDER, MANIFEST), asdict(self))

    def set_filters(self, **changes: object) -> Filters:
        unknown = set(changes) - set(Filters.__dataclass_fields__)
        if unknown:
            raise SettingsError(f"unknown filters {sorted(unknown)}")
        if changes.get("mode", "all") not in ("all", "custom"):
            raise SettingsError("mode must be all or custom")
        self.filters |= {k: list(v) if isinstance(v, (tuple, set)) else v for k, v in changes.items()}
        self.save()
        return self.as_filters()

    def as_filters(self) -> Filters:
        return Filters(**{k: tuple(v) if isinstance(v, list) else v for k, v in self.filters.items()})

    def record(self, stats: dict) -> None:
        self.indexed, self.stats = True, stats
        self.save()


class Settings:
    """What a user chose for all projects: parsers' configuration, and recent projects, latest first."""

    def __init__(self, path: str) -> None:
        self.path, self.data = path, _load(path)

    def opened(self, project: Project) -> list[dict]:
        rest = [p for p in self.data.get("recent", []) if p["root"] != project.root]
        self.data["recent"] = [{"root": project.root, "project_id": project.project_id, "at": _now()}, *rest][:RECENT]
        _save(self.path, self.data)
        return self.data["recent"]

    def parser(self, name: str, defaults: dict) -> dict:
        """Defaults with the user's values. Keys that the defaults no longer have are dropped, as are notes (_key)."""
        own = self.data.get("parsers", {}).get(name, {})
        merged = defaults | {k: v for k, v in own.items() if k in defaults or not defaults}
        return {k: v for k, v in merged.items() if not k.startswith("_")}

    def set_parser(self, name: str, changes: dict, defaults: dict) -> dict:
        """Values must be of known keys and of the kind of the default."""
        for k, v in changes.items():
            if k.startswith("_") or (k not in defaults and k != "enabled"):
                raise SettingsError(f"unknown key {k}")
            want = defaults.get(k)
            kinds = (bool,) if k == "enabled" or isinstance(want, bool) else (int, float) if isinstance(want, (int, float)) else (type(want),)
            if want is None and k != "enabled":
                continue
            if not isinstance(v, kinds) or (isinstance(v, bool) and bool not in kinds):
                raise SettingsError(f"{k} must be {' or '.join(t.__name__ for t in kinds)}")
        self.data.setdefault("parsers", {}).setdefault(name, {}).update(changes)
        _save(self.path, self.data)
        return self.parser(name, defaults)
