"""Parsers of markup, notebooks and plain texts."""

from __future__ import annotations

import csv
import io
import json
import re
from html.parser import HTMLParser

from tessera.sources.parsers.base import Parser, comment, function, imported, klass, line_at, line_starts, result, unique, variable

MAX_CHARS = 1_048_576
MAX_HTML = 5 * 1_048_576
_EXTERNAL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//|^(?:mailto|tel):")
# What an import points at, by suffix.
ASSETS = {
    "document": ("md", "markdown", "html", "htm", "pdf", "rst", "txt"),
    "image": ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp"),
    "stylesheet": ("css", "scss", "less"),
    "script": ("js", "mjs", "ts"),
}


def link_kind(url: str) -> str:
    return "external" if _EXTERNAL.match(url) else "anchor" if url.startswith("#") else "internal"


def asset_kind(url: str) -> str:
    suffix = re.sub(r"[?#].*", "", url).rsplit(".", 1)[-1].lower()
    return next((k for k, s in ASSETS.items() if suffix in s), "asset")


def slug(text: str) -> str:
    return re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", text.strip().lower()))


def sections_of(heads: list[dict], lines: list[str]) -> list[dict]:
    """heads (name, level, line_start) with their end, content and parent."""
    out, stack = [], []
    heads = sorted(heads, key=lambda h: h["line_start"])
    for k, h in enumerate(heads):
        end = heads[k + 1]["line_start"] - 1 if k + 1 < len(heads) else len(lines)
        while end > h["line_start"] and not lines[end - 1].strip():
            end -= 1
        while stack and stack[-1][0] >= h["level"]:
            stack.pop()
        out.append(h | {"line_end": end, "content": "\n".join(lines[h["line_start"] - 1 : end]), "parent_section": stack[-1][1] if stack else None})
        stack.append((h["level"], h["name"]))
    return out


def document(path: str, source: str, kind: str, name: str | None = None) -> dict:
    return {"name": name or path.rsplit("/", 1)[-1], "doc_type": kind, "line_start": 1, "line_end": max(1, source.count("\n") + (not source.endswith("\n"))), "content": source}


def _frontmatter(source: str) -> tuple[dict | None, int]:
    """The YAML head, and how many lines it has."""
    m = re.match(r"---[ \t]*\n([\s\S]*?)\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", source)
    if not m:
        return None, 0
    try:
        import yaml

        data = yaml.safe_load(m[1])
    except ImportError:
        data = {k: v for k, v in re.findall(r"(?m)^([\w-]+):[ \t]*(.*)$", m[1])}
    except Exception:  # noqa: BLE001  the head isn't YAML, so it is text
        return None, 0
    return (data if isinstance(data, dict) else None), m[0].count("\n")


def _plain(text: str) -> str:
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(\*\*|__|\*|_|`|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text).strip()


def parse_markdown(path: str, source: str) -> dict | None:
    if len(source) > MAX_CHARS:
        return None
    meta, skip = _frontmatter(source)
    lines = source.splitlines()
    heads, blocks, links, tables, tasks, comments, wiki, calls = [], [], [], [], [], [], [], []
    fence: tuple[str, int, str, list[str]] | None = None
    n = skip
    while n < len(lines):
        t, n = lines[n], n + 1
        if fence is not None:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}+[ \t]*$", t):
                blocks.append({"language": fence[2] or None, "line_start": fence[1], "line_end": n, "content": "\n".join(fence[3])})
                fence = None
            else:
                fence[3].append(t)
            continue
        if m := re.match(r"^ {0,3}(`{3,}|~{3,})[ \t]*([\w+#.-]*)", t):
            fence = (m[1], n, m[2], [])
            continue
        if m := re.match(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", t):
            name = _plain(m[2])
            own = re.search(r"\s*\{#([\w-]+)\}$", name)
            name = name[: own.start()] if own else name
            heads.append({"name": name, "level": len(m[1]), "line_start": n, "anchor": own[1] if own else slug(name)})
        elif (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", t)) and n >= 2 and lines[n - 2].strip() and n - 2 >= skip and not re.match(r"^\s*(?:[-*+>|]|\d+\.|#)", lines[n - 2]):
            name = _plain(lines[n - 2])
            heads.append({"name": name, "level": 1 if t.strip()[0] == "=" else 2, "line_start": n - 1, "anchor": slug(name)})
        if m := re.match(r"^\s*(?:[-*+]|\d+[.)])[ \t]+\[([ xX])\][ \t]+(.*)$", t):
            tasks.append({"text": _plain(m[2]), "checked": m[1] != " ", "line": n})
        bare = re.sub(r"`[^`]*`", "", t)
        for m in re.finditer(r"(!?)\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?([^\s)>]+)>?(?:\s+[\"'][^)]*)?\)", bare):
            links.append({"url": m[3], "text": _plain(m[2]), "is_image": bool(m[1]), "line": n, "link_type": "image" if m[1] else link_kind(m[3])})
        for m in re.finditer(r"<(https?://[^\s>]+)>", bare):
            links.append({"url": m[1], "text": m[1], "is_image": False, "line": n, "link_type": "external"})
        for m in re.finditer(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", bare):
            wiki.append({"target": m[1].strip(), "alias": (m[2] or "").strip() or None, "line": n})
        if m := re.match(r"^>\s*\[!(\w+)\][-+]?[ \t]*(.*)$", t):
            calls.append({"kind": m[1].lower(), "title": m[2].strip(), "line": n})
        elif m := re.match(r"^(?:!!!|\?\?\?)\s+(\w+)(?:\s+\"([^\"]*)\")?", t):
            calls.append({"kind": m[1].lower(), "title": m[2] or "", "line": n})
        elif m := re.match(r"^:::+\s*\{?\.?(\w+)", t):
            calls.append({"kind": m[1].lower(), "title": "", "line": n})
        if n < len(lines) and "|" in t and re.match(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$", lines[n]) and "|" in lines[n] + t:
            cells = lambda x: [_plain(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
            start, rows, k = n, [], n + 1
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                rows.append(cells(lines[k]))
                k += 1
            tables.append({"headers": cells(t), "rows": rows, "line_start": start, "line_end": k})
    if fence is not None:
        blocks.append({"language": fence[2] or None, "line_start": fence[1], "line_end": len(lines), "content": "\n".join(fence[3])})
    for m in re.finditer(r"<!--([\s\S]*?)-->", source):
        comments += comment(m[1], line_at(source, m.start()))
    title = (meta or {}).get("title") or next((h["name"] for h in heads if h["level"] == 1), None)
    own = [x for x in links if x["link_type"] in ("internal", "image") and not _EXTERNAL.match(x["url"])]
    imports = [imported(re.sub(r"#.*", "", x["url"]), x["line"]) | {"kind": asset_kind(x["url"])} for x in own]
    imports += [imported(w["target"], w["line"], alias=w["alias"]) | {"kind": "document"} for w in wiki]
    return result(
        path,
        documents=[document(path, source, "markdown", str(title) if title else None)],
        sections=sections_of(heads, lines), code_blocks=blocks, links=links, tables=tables, task_items=tasks,
        comments=comments, imports=unique(imports, "module", "line"), frontmatter=meta, title=str(title) if title else None,
        wikilinks=wiki, callouts=calls,
    )


class _Page(HTMLParser):
    """Collects what parse_html() tells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.heads, self.blocks, self.links, self.meta, self.assets, self.notes, self.text = "", [], [], [], {}, [], [], []
        self.open: list[tuple[str, int, list[str], dict]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a, line = {k: v or "" for k, v in attrs}, self.getpos()[0]
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in ("title", "script", "style", "pre", "a", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.append((tag, line, [], a))
        if tag == "img" and a.get("src"):
            self.links.append({"url": a["src"], "text": a.get("alt", ""), "is_image": True, "line": line, "link_type": "image"})
            self.assets.append((a["src"], line))
        elif tag == "link" and a.get("href"):
            self.links.append({"url": a["href"], "text": a.get("rel", ""), "is_image": False, "line": line, "link_type": link_kind(a["href"])})
            self.assets.append((a["href"], line))
        elif tag == "script" and a.get("src"):
            self.assets.append((a["src"], line))
        elif tag == "meta" and (a.get("name") or a.get("property")):
            self.meta[a.get("name") or a["property"]] = a.get("content", "")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, line, text, a = self.open.pop(k)
                flat = " ".join("".join(text).split())
                if tag == "title":
                    self.title = self.title or flat
                elif tag == "a" and a.get("href"):
                    self.links.append({"url": a["href"], "text": flat, "is_image": False, "line": line, "link_type": link_kind(a["href"])})
                elif tag[0] == "h" and tag[1:].isdigit() and flat:
                    self.heads.append({"name": flat, "level": int(tag[1]), "line_start": line, "anchor": a.get("id") or slug(flat)})
                elif tag in ("script", "style", "pre") and "".join(text).strip():
                    kind = {"script": "javascript", "style": "css", "pre": None}[tag]
                    self.blocks.append({"language": kind, "line_start": line, "line_end": self.getpos()[0], "content": "".join(text)})
                return

    def handle_data(self, data: str) -> None:
        for x in self.open:
            x[2].append(data)
        if not self.hidden and not any(x[0] == "title" for x in self.open) and data.strip():
            self.text.append(data.strip())

    def handle_comment(self, data: str) -> None:
        self.notes += comment(data, self.getpos()[0])


def parse_html(path: str, source: str) -> dict | None:
    if len(source) > MAX_HTML:
        return None
    p = _Page()
    p.feed(source)
    p.close()
    seen = "\n".join(p.text)
    doc = document(path, source, "html", p.title or None) | {"content": seen}
    imports = [imported(u, n) | {"kind": asset_kind(u)} for u, n in p.assets if not u.startswith("data:")]
    return result(
        path, documents=[doc], sections=sections_of(p.heads, source.split("\n")), code_blocks=p.blocks,
        links=sorted(p.links, key=lambda x: x["line"]), comments=p.notes, imports=unique(imports, "module", "line"),
        title=p.title or None, frontmatter=p.meta or None,
    )


def _titles(source: str, found: list[tuple[int, int, str]]) -> list[dict]:
    """Classes from (line, level, title), each to the next title."""
    starts = line_starts(source)
    out = []
    for k, (n, _, name) in enumerate(found):
        end = starts[found[k + 1][0] - 1][1] if k + 1 < len(found) else len(source)
        out.append(klass(name, source, starts[n - 1][1], max(starts[n - 1][1] + 1, end)))
    return out


def parse_rst(path: str, source: str) -> dict:
    lines = source.split("\n")
    order: list[str] = []
    heads = []
    for n in range(1, len(lines)):
        mark, text = lines[n].rstrip(), lines[n - 1].strip()
        if text and re.match(r"^([=\-~`'\"^*+#:.<>_])\1{2,}$", mark) and len(mark) >= len(text) and not re.match(r"^([=\-~^*+#])\1{2,}$", text):
            if mark[0] not in order:
                order.append(mark[0])
            heads.append((n, order.index(mark[0]) + 1, text))
    refs = [imported(m[1], line_at(source, m.start())) for rx in (r":(?:ref|doc|mod|class|func):`(?:[^`<]*<)?([^`>]+)>?`", r"`[^`<]+<([^`>]+)>`_", r"(?<![<\w])(https?://[^\s>`]+)", r"^\.\.\s+(?:include|literalinclude|image|figure)::\s*(\S+)") for m in re.finditer(rx, source, re.M)]
    blocks = []
    for k, m in enumerate(re.finditer(r"(?m)^(?:\.\.\s+code(?:-block)?::\s*(\w*)[^\n]*|[^\n]*::)[ \t]*\n(?:[ \t]*\n)+((?:[ \t]+[^\n]*(?:\n|\Z)|[ \t]*\n)+)", source), 1):
        blocks.append(function(m[1] or f"code_{k}", source, m.start(), m.end()))
    marks = [variable(m[1], line_at(source, m.start()), m[2].strip()) for m in re.finditer(r"(?m)^\.\.\s+([\w-]+)::[ \t]*([^\n]*)", source)]
    return result(path, classes=_titles(source, heads), imports=unique(refs, "module", "line"), functions=blocks, variables=marks, documents=[document(path, source, "rst")])


def parse_asciidoc(path: str, source: str) -> dict:
    heads = [(n, len(m[1]), m[2].strip()) for n, _, t in line_starts(source) if (m := re.match(r"^(={1,6})\s+(\S.*)$", t))]
    refs = [imported(m[1], line_at(source, m.start())) for rx in (r"^include::([^\[\n]+)\[", r"xref:([^\[\s]+)\[", r"<<([^,>\n]+)[^>\n]*>>", r"link:([^\[\s]+)\[", r"(https?://[^\s\[\]]+)") for m in re.finditer(rx, source, re.M)]
    blocks = [function(m[1] or f"listing_{k}", source, m.start(), m.end()) for k, m in enumerate(re.finditer(r"(?m)^(?:\[source(?:,\s*(\w+))?[^\]]*\]\n)?-{4,}\n[\s\S]*?\n-{4,}$", source), 1)]
    marks = [variable(m[1], line_at(source, m.start()), m[2].strip()) for m in re.finditer(r"(?m)^:([\w-]+):[ \t]*([^\n]*)", source)]
    return result(path, classes=_titles(source, heads), imports=unique(refs, "module", "line"), functions=blocks, variables=marks, documents=[document(path, source, "asciidoc")])


def parse_org(path: str, source: str) -> dict:
    heads = [(n, len(m[1]), re.sub(r"\s+:[\w:@]+:\s*$", "", re.sub(r"^(?:TODO|DONE)\s+", "", m[2])).strip()) for n, _, t in line_starts(source) if (m := re.match(r"^(\*+)\s+(\S.*)$", t))]
    refs = [imported(m[1], line_at(source, m.start())) for m in re.finditer(r"\[\[([^\]]+)\](?:\[[^\]]*\])?\]", source)]
    refs += [imported(m[1], line_at(source, m.start())) for m in re.finditer(r"(?mi)^#\+INCLUDE:\s*\"?([^\s\"]+)", source)]
    blocks = [function(m[1] or f"src_{k}", source, m.start(), m.end()) for k, m in enumerate(re.finditer(r"(?mi)^[ \t]*#\+BEGIN_SRC[ \t]*(\S*)[^\n]*\n[\s\S]*?^[ \t]*#\+END_SRC", source), 1)]
    marks = [variable(m[1], line_at(source, m.start()), m[2].strip()) for m in re.finditer(r"(?m)^#\+(?!BEGIN|END|begin|end)(\w+):[ \t]*([^\n]*)", source)]
    marks += [variable(m[1], line_at(source, m.start()), m[2].strip()) for m in re.finditer(r"(?m)^[ \t]*:(?!PROPERTIES|END)([\w-]+):[ \t]+([^\n]+)", source)]
    return result(path, classes=_titles(source, heads), imports=unique(refs, "module", "line"), functions=blocks, variables=marks, documents=[document(path, source, "org")])


def parse_rmarkdown(path: str, source: str) -> dict:
    chunks, imports, variables = [], [], []
    for k, m in enumerate(re.finditer(r"(?m)^```\{r[ ,]*([\w-]*)[^}]*\}[ \t]*\n([\s\S]*?)^```", source), 1):
        chunks.append(function(m[1] or f"chunk_{k}", source, m.start(), m.end()))
        for x in re.finditer(r"\b(?:library|require)\(\s*[\"']?([\w.]+)", m[2]):
            imports.append(imported(x[1], line_at(source, m.start(2) + x.start())))
        for x in re.finditer(r"(?m)^([A-Za-z_.][\w.]*)\s*<-\s*(?!function\b)([^\n]*)", m[2]):
            variables.append(variable(x[1], line_at(source, m.start(2) + x.start()), x[2]))
    heads = [{"name": m[2].strip(), "level": len(m[1]), "line_start": line_at(source, m.start())} for m in re.finditer(r"(?m)^(#{1,6})[ \t]+([^\n]+)", re.sub(r"(?m)^```[\s\S]*?^```", lambda b: re.sub(r"[^\n]", " ", b[0]), source))]
    return result(path, functions=chunks, imports=imports, variables=variables, sections=sections_of(heads, source.splitlines()), documents=[document(path, source, "rmarkdown")])


def parse_notebook(path: str, source: str) -> dict | None:
    try:
        cells = json.loads(source).get("cells", [])
    except (ValueError, AttributeError):
        return None
    functions, variables, comments, imports = [], [], [], []
    for k, cell in enumerate(cells):
        text = cell.get("source", "")
        text = "".join(text) if isinstance(text, list) else text
        if cell.get("cell_type") == "code":
            functions.append({"name": f"cell_{k}", "line_start": 1, "line_end": text.count("\n") + 1, "source": text, "calls": []})
            variables += [variable(m[1], 1) for m in re.finditer(r"(?m)^([A-Za-z_]\w*)\s*=(?!=)", text)]
            imports += [imported(m[1] or m[2], 1) for m in re.finditer(r"(?m)^(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import)", text)]
        elif cell.get("cell_type") == "markdown":
            head = next((x.lstrip("# ").strip() for x in text.split("\n") if x.strip()), "")
            comments.append({"line": k + 1, "tag": "SECTION", "text": head})
    return result(path, functions=functions, variables=unique(variables, "name"), comments=comments, imports=unique(imports, "module"))


def parse_pdf(path: str, source: str) -> dict | None:
    """PDF texts need a library that isn't a dependency; without it such a file stays a plain file."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    reader = PdfReader(io.BytesIO(source.encode("latin-1")))
    pages = [p.extract_text() or "" for p in reader.pages]
    title = (reader.metadata.title if reader.metadata else None) or None
    return result(path, documents=[document(path, "\n".join(pages), "pdf", title)], title=title)


def _flat(value: object, at: str = "") -> list[str]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _flat(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in _flat(v, f"{at}[{k}]")]
    return [f"{at}: {value}"]


def parse_text(path: str, source: str) -> dict | None:
    """Any other text as one document: JSON as one line a value, CSV as one line a row."""
    if len(source) > MAX_CHARS:
        return None
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    text = source
    if suffix == "json":
        try:
            text = "\n".join(_flat(json.loads(source)))
        except ValueError:
            text = source
    elif suffix == "csv":
        rows = list(csv.reader(io.StringIO(source)))
        text = "\n".join("; ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False)) for r in rows[1:]) if rows else ""
    kinds = {"md": "markdown", "yml": "yaml", "htm": "html", "log": "log"}
    return result(path, documents=[document(path, source, kinds.get(suffix, suffix or "text")) | {"content": text}])


def parsers() -> list[Parser]:
    return [
        Parser("asciidoc1", ("*.adoc", "*.asciidoc"), parse_asciidoc),
        Parser("html5", ("*.html", "*.htm", "*.xhtml"), parse_html),
        Parser("jupyter1", ("*.ipynb",), parse_notebook, ignore_dirs=(".ipynb_checkpoints",)),
        Parser("markdown_gfm", ("*.md", "*.markdown"), parse_markdown),
        Parser("org1", ("*.org",), parse_org),
        Parser("pdf_pypdf", ("*.pdf",), parse_pdf),
        Parser("rmarkdown1", ("*.rmd", "*.Rmd"), parse_rmarkdown),
        Parser("rst1", ("*.rst",), parse_rst),
    ]


def text_parser() -> Parser:
    return Parser("text", ("*.txt", "*.log", "*.text", "*.json", "*.yaml", "*.yml", "*.csv", "*.toml", "*.xml", "*.html", "*.htm", "*.ini", "*.cfg", "*.conf"), parse_text)
