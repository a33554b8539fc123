"""Functions of paths and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by suffix.
LANGUAGES = {
    "py": "python", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "txt": "text", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "html": "html", "htm": "html", "xml": "xml", "svg": "xml", "css": "css",
    "scss": "scss", "less": "less", "sh": "bash", "bash": "bash", "zsh": "bash", "rb": "ruby", "go": "go",
    "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift",
    "kt": "kotlin", "sql": "sql", "toml": "toml", "ini": "ini", "env": "ini", "dockerfile": "dockerfile",
}


def glob_regex(glob: str) -> str:
    """A Java pattern for a shell glob: *, ?, [..] and [!..]; all else is literal."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out + "$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def suffix(path: Column) -> Column:
    """Lower-case suffix without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv])
    plain = F.lower(base_name(path)) == "dockerfile"
    return F.when(plain, "dockerfile").otherwise(F.coalesce(table[suffix(path)], F.lit("")))


def module(path: Column) -> Column:
    """Dotted module name of a path."""
    dotted = F.regexp_replace(F.regexp_replace(path, "/", "."), r"\.py$", "")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def file_of(node_id: Column) -> Column:
    """The path within a node id of the form kind::path or kind::path::more."""
    return F.get(F.split(node_id, "::"), F.lit(1))


def slug(text: Column) -> Column:
    """An anchor: lower case, only letters, digits, _, - and blanks, which become -."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(kept, r"\s+", "-")


def link_kind(url: Column) -> Column:
    return (
        F.when(url.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//|^(?:mailto|tel):"), "external")
        .when(url.startswith("#"), "anchor")
        .otherwise("internal")
    )
