"""What all parsers share. A parser turns a path and a source into lists of entities."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field

Parsed = dict[str, object]
TAGGED = re.compile(r"\b(TODO|FIXME|NOTE|HACK|XXX)\b[:\s]*(.*)", re.I)


@dataclass(frozen=True)
class Parser:
    """names: globs of base names; holds: parts of which one must be in the lower-case path, if there are any."""

    name: str
    names: tuple[str, ...]
    parse: Callable[[str, str], Parsed | None]
    holds: tuple[str, ...] = ()
    ignore_dirs: tuple[str, ...] = ()
    ignore_files: tuple[str, ...] = ()
    dir_markers: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)

    def can_parse(self, path: str) -> bool:
        if self.config.get("enabled", True) is False:
            return False
        base = path.rsplit("/", 1)[-1]
        return any(fnmatch.fnmatchcase(base, g) for g in self.names) and (
            not self.holds or any(h in path.lower() for h in self.holds)
        )


def result(path: str, **lists: object) -> Parsed:
    return {"file": path, "functions": [], "classes": [], "imports": [], "variables": [], "comments": []} | lists


def line_at(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def entity(name: str, source: str, start: int, end: int, **more: object) -> dict:
    return {
        "name": name,
        "line_start": line_at(source, start),
        "line_end": line_at(source, max(start, end - 1)),
        "source": source[start:end],
    } | more


def function(name: str, source: str, start: int, end: int, calls: list | None = None, **more: object) -> dict:
    return entity(name, source, start, end, calls=calls or [], **more)


def klass(name: str, source: str, start: int, end: int, bases: list | None = None, methods: list | None = None, **more: object) -> dict:
    return entity(name, source, start, end, bases=bases or [], methods=methods or [], **more)


def variable(name: str, line: int, value: str | None = None) -> dict:
    return {"name": name, "line": line, "value": value}


def imported(module: str, line: int, names: list[str] | None = None, alias: str | None = None) -> dict:
    return {"module": module, "names": names or [], "alias": alias, "line": line, "level": 0}


def tag_pattern(tags: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(rf"\b({'|'.join(map(re.escape, tags))})\b[:\s]*(.*)", re.I)


def comment(text: str, line: int, tagged: re.Pattern[str] = TAGGED) -> list[dict]:
    """The comment, if it has a tag."""
    m = tagged.search(text)
    return [{"line": line, "tag": m[1].upper(), "text": m[2].strip().removesuffix("*/").strip()}] if m else []


def unique(items: list[dict], *keys: str) -> list[dict]:
    seen, out = set(), []
    for x in items:
        k = tuple(x[n] for n in keys)
        if k not in seen:
            seen.add(k)
            out.append(x)
    return out


def line_starts(source: str) -> list[tuple[int, int, str]]:
    """(line, offset, text) of each line."""
    out, at = [], 0
    for n, text in enumerate(source.split("\n"), 1):
        out.append((n, at, text))
        at += len(text) + 1
    return out
