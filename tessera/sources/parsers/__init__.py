"""The registry of parsers, and the rows of what they find."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace
from functools import partial

from tessera.sources.parsers import code, config, markup, python
from tessera.sources.parsers.base import Parsed, Parser

# Folders that are never walked.
CORE_IGNORED = ("build", "dist", "_build", ".build", "htmlcov", ".coverage", ".idea", ".vscode", ".git")


def registry(settings: dict[str, dict] | None = None, text: bool = True) -> list[Parser]:
    """All parsers by name, the first that fits a path parses it; then plain texts. settings: configuration by name;
    ``enabled: false`` leaves a parser out. Longer globs come before the general ones they are part of."""
    found = sorted([*code.parsers(), *config.parsers(), *markup.parsers(), *python.parsers()], key=lambda p: p.name)
    # Special files before the formats that they are written in, so that no parser is shadowed.
    special = ("docker_compose1", "github_actions1", "jsonschema", "k8s_manifest1", "maven1", "openapi3", "gradle1")
    found.sort(key=lambda p: (p.name not in special, p.name == "node20", p.name))
    out = [_configured(p, (settings or {}).get(p.name, {})) for p in found]
    out = [p for p in out if p.config.get("enabled", True) is not False]
    return [*out, markup.text_parser()] if text else out


def _configured(parser: Parser, config: dict) -> Parser:
    if config and parser.parse is python.parse_python:
        return replace(parser, config=config, parse=partial(python.parse_python, settings=config))
    return replace(parser, config=config)


def dispatch(path: str, parsers: list[Parser]) -> Parser | None:
    return next((p for p in parsers if p.can_parse(path)), None)


def ignored(parsers: list[Parser]) -> tuple[set[str], list[str], list[str]]:
    """Folder names, file globs and marker files that the parsers leave out."""
    dirs, files, marks = set(CORE_IGNORED), [], []
    for p in parsers:
        dirs |= {*p.ignore_dirs, *p.config.get("ignore_dirs", ())}
        files += [*p.ignore_files, *p.config.get("ignore_files", ())]
        marks += [*p.dir_markers, *p.config.get("ignore_dir_markers", ())]
    return dirs, files, marks


def parse(path: str, source: str, parsers: list[Parser]) -> tuple[Parsed | None, str | None, str | None]:
    """What the first parser that fits finds, its name, and what went wrong."""
    p = dispatch(path, parsers)
    if p is None:
        return None, None, None
    try:
        return p.parse(path, source), p.name, None
    except Exception as e:  # noqa: BLE001  one file must not end a job; the error is told in its row
        return None, p.name, f"{type(e).__name__}: {e}"


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


_FUNCTION = ("line_start", "line_end", "source", "args", "params", "return_annotation", "decorators", "docstring", "signature_hash", "complexity", "loc", "context_managers", "exceptions")


def rows(path: str, parsed: Parsed | None, md5: str) -> tuple[list[dict], list[dict], list[dict], list[dict]]:
    """Nodes, edges, calls and imports of one file. Of nodes with one id the later overwrites what it has."""
    nodes: dict[str, dict] = {}
    edges: dict[tuple[str, str], dict] = {}
    calls, imports = [], []

    def node(id_: str, type_: str, name: str, /, **more: object) -> str:
        have = {k: v for k, v in more.items() if v is not None}
        nodes[id_] = nodes.get(id_, {}) | {"id": id_, "type": type_, "name": name, "path": path} | have
        return id_

    def edge(a: str, b: str, kind: str) -> None:
        edges[a, b] = {"source": a, "target": b, "type": kind, "call_args": None, "call_line": None}

    def called(owner: str, found: list) -> None:
        for c in found:
            calls.append({"caller": owner, "path": path, "name": c["name"], "args": [str(a) for a in c.get("args", [])], "line": c.get("line")})

    p = parsed or {}
    file = node(f"file::{path}", "file", path.rsplit("/", 1)[-1], file_md5=md5, module_docstring=p.get("module_docstring"), patterns=p.get("patterns") or None)
    for f in p.get("functions", []):
        id_ = node(
            f"func::{path}::{f['name']}", "function", f["name"], source_md5=_md5(f.get("source", "")),
            is_async=bool(f.get("is_async")), is_nested=bool(f.get("is_nested")), is_test=bool(f.get("is_test")),
            **{k: f.get(k) for k in _FUNCTION},
        )
        edge(file, id_, "defines")
        called(id_, f.get("calls", []))
    for c in p.get("classes", []):
        own = node(
            f"class::{path}::{c['name']}", "class", c["name"], line_start=c["line_start"], line_end=c["line_end"], source=c.get("source"),
            bases=c.get("bases", []), decorators=c.get("decorators"), docstring=c.get("docstring"), class_vars=c.get("class_vars"),
            is_dataclass=bool(c.get("is_dataclass")), is_namedtuple=bool(c.get("is_namedtuple")),
        )
        edge(file, own, "defines")
        for v in c.get("class_vars", []):
            edge(own, node(f"var::{path}::{c['name']}::{v['name']}", "variable", v["name"], line=v.get("line"), annotation=v.get("annotation"), value=v.get("value")), "defines")
        for m in c.get("methods", []):
            id_ = node(f"method::{path}::{c['name']}::{m['name']}", "method", m["name"], parent_class=c["name"], **{k: m.get(k) for k in _FUNCTION})
            edge(own, id_, "defines")
            called(id_, m.get("calls", []))
    for checking, key in ((None, "imports"), (True, "type_checking_imports")):
        for i in p.get(key, []):
            names, module, line = i.get("names") or [], i.get("module") or "", i.get("line") or 0
            label = f"from {module} import {', '.join(names)}" if names else f"import {module}"
            edge(file, node(f"import::{path}::{module}::L{line}", "import", label, module=module, names=names, line=line, level=i.get("level") or 0, kind=i.get("kind"), type_checking=checking), "imports")
            if not checking:
                imports.append({"path": path, "module": module, "names": names, "alias": i.get("alias"), "line": line})
    for v in p.get("variables", []):
        edge(file, node(f"var::{path}::{v['name']}", "variable", v["name"], line=v.get("line"), value=v.get("value")), "defines")
    for c in p.get("comments", []):
        text, tag = c.get("text") or c.get("content") or "", c.get("tag") or ""
        edge(file, node(f"comment::{path}::L{c['line']}", "comment", (f"{tag}: {text}" if tag else text)[:100], tag=tag, text=text, line=c["line"]), "defines")
    for s in p.get("strings", []):
        edge(file, node(f"string::{path}::L{s['line']}", "string", (s.get("value") or "")[:80], kind=s.get("kind"), value=s.get("value"), line=s["line"]), "defines")
    for d in p.get("documents", []):
        meta = p.get("frontmatter")
        edge(
            file,
            node(
                f"doc::{path}", "document", d["name"], doc_type=d["doc_type"], line_start=d["line_start"], line_end=d["line_end"], source=d["content"],
                frontmatter=json.dumps(meta, default=str, ensure_ascii=False) if meta else None, title=p.get("title"),
            ),
            "defines",
        )
    for s in p.get("sections", []):
        edge(file, node(f"section::{path}::L{s['line_start']}", "section", s["name"], level=s["level"], line_start=s["line_start"], line_end=s["line_end"], source=s.get("content", ""), parent_section=s.get("parent_section")), "defines")
    for b in p.get("code_blocks", []):
        edge(file, node(f"codeblock::{path}::L{b['line_start']}", "code_block", f"```{b.get('language') or ''}", language=b.get("language"), line_start=b["line_start"], line_end=b["line_end"], source=b["content"]), "defines")
    for k in p.get("links", []):
        edge(file, node(f"link::{path}::L{k['line']}", "link", k.get("text") or k["url"], url=k["url"], line=k["line"], link_type=k.get("link_type"), is_image=bool(k.get("is_image"))), "defines")
    for t in p.get("tables", []):
        head = " | ".join(t.get("headers", []))
        edge(file, node(f"table::{path}::L{t['line_start']}", "table", head[:100] or "table", headers=t.get("headers", []), rows=t.get("rows", []), line_start=t["line_start"], line_end=t["line_end"]), "defines")
    for t in p.get("task_items", []):
        mark = "☑" if t.get("checked") else "☐"
        edge(file, node(f"task::{path}::L{t['line']}", "task_item", f"{mark} {t['text'][:80]}", text=t["text"], checked=bool(t.get("checked")), line=t["line"]), "defines")
    return [*nodes.values()], [*edges.values()], calls, imports
