"""Parsers of programming languages, driven by one table.

A source is masked first: comments and the insides of strings become blanks of equal length, so that patterns and
bracket matching see code alone and offsets stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.sources.parsers.base import Parser, comment, function, imported, klass, line_at, result, unique, variable

ID = r"[A-Za-z_$][\w$]*"
C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
HASH_COMMENT = r"#[^\n]*"
STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
CALL = re.compile(r"(?<![\w$@#])((?:[A-Za-z_$][\w$]*(?:\.|::|->|\?\.))*[A-Za-z_$][\w$]*[!?]?)\s*\(")
#: Words that look like a declared name before a bracket but aren't one.
NOT_NAMES = frozenset("if for while switch catch return else do try sizeof throw function foreach using lock".split())
COMMON_WORDS = frozenset("if for while switch return catch sizeof throw else do new case in not and or function func fn def await typeof super yield".split())


@dataclass(frozen=True)
class Language:
    """Patterns use the groups name, bases, owner, module, names, alias and value; a pattern of types may name bases."""

    types: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    variables: tuple[str, ...] = ()
    comments: str = C_COMMENT
    strings: str = STRINGS
    block: str = "brace"
    words: frozenset[str] = frozenset()
    bare_calls: bool = False


def mask(source: str, lang: Language) -> tuple[str, list[tuple[int, str]]]:
    """The masked source, and the comments with their offsets."""
    rx = re.compile(rf"(?P<c>{lang.comments})|(?P<s>{lang.strings})")
    found = []

    def blank(m: re.Match) -> str:
        text = m[0]
        if m["c"] is not None:
            found.append((m.start(), text))
            return re.sub(r"[^\n]", " ", text)
        return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1] if len(text) > 1 else text

    return rx.sub(blank, source), found


_GOES_ON = re.compile(r"\s*(?:\{|where\b|throws\b|extends\b|implements\b|with\b|noexcept\b|const\b|:|->|=>|\||&&)")


def brace_end(code: str, at: int) -> tuple[int, int]:
    """Offsets of the body of a header that begins at ``at``: its { and what follows its }. (-1, end of the statement) if
    it has none; the end of the text if it isn't closed."""
    depth, open_ = 0, -1
    for m in re.finditer(r"[()\[\]{};\n]", code[at:]):
        c, k = m[0], at + m.start()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == "{":
            open_ = k
            break
        elif depth <= 0 and c == ";":
            return -1, k + 1
        elif depth <= 0 and c == "\n":
            before = code[at:k].rstrip()
            if before and before[-1] not in ",+|&=:<" and not _GOES_ON.match(code, k):
                return -1, k
    if open_ < 0:
        return -1, len(code)
    level = 0
    for m in re.finditer(r"[{}]", code[open_:]):
        level += 1 if m[0] == "{" else -1
        if not level:
            return open_, open_ + m.end()
    return open_, len(code)


_OPENERS = {
    "ruby": re.compile(r"^[ \t]*(?:class|module|def|if|unless|while|until|for|case|begin)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|=[ \t]*(?:if|case|begin)\b|^[ \t]*end\b", re.M),
    "lua": re.compile(r"\b(?:function|if|do|repeat|end|until)\b"),
    "elixir": re.compile(r"\bdo\b(?!:)|\bfn\b|\bend\b"),
}


def word_end(code: str, at: int, kind: str) -> tuple[int, int]:
    """Offsets of a body that ``end`` closes."""
    depth, body = 0, -1
    for m in _OPENERS[kind].finditer(code, at):
        word = m[0].strip()
        if word in ("end", "until"):
            depth -= 1
            if depth <= 0:
                return body, m.end()
        else:
            depth += 1
            body = m.end() if body < 0 else body
    return body, len(code)


def body_of(code: str, at: int, lang: Language) -> tuple[int, int]:
    return brace_end(code, at) if lang.block == "brace" else word_end(code, at, lang.block)


def calls_in(code: str, start: int, end: int, lang: Language, line0: str) -> list[dict]:
    out = []
    for m in CALL.finditer(code, start, end):
        name = m[1].replace("->", ".").replace("?.", ".")
        last = re.split(r"\.|::", name)[-1]
        plain = last == name and (last in COMMON_WORDS or last in lang.words)
        if not plain and re.search(r"[A-Za-z_]", last):
            out.append({"name": name, "args": [], "line": line_at(line0, m.start())})
    if lang.bare_calls:
        for m in re.finditer(r"(?m)^[ \t]*([A-Za-z_][\w.-]*[!?]?)(?=[ \t\n;]|$)(?![ \t]*(?:=|:|\())", code[start:end]):
            if m[1] not in COMMON_WORDS and m[1] not in lang.words and m[1] not in ("end", "then", "fi", "done", "esac"):
                out.append({"name": m[1], "args": [], "line": line_at(line0, start + m.start(1))})
    return unique(sorted(out, key=lambda c: c["line"]), "name", "line")


def _names(text: str | None) -> list[str]:
    """Names in a list of bases or parameters, without type arguments and words that only qualify."""
    if not text:
        return []
    flat = text
    while (less := re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", flat)) != flat:
        flat = less
    skip = {"public", "private", "protected", "virtual", "extends", "implements", "with", "where", "override"}
    out = []
    for part in re.split(r",|\bwith\b|\bimplements\b|\bextends\b|\+|&", flat):
        words = [w for w in re.findall(r"[A-Za-z_$][\w$.:]*", part) if w not in skip]
        if words:
            out.append(words[0])
    return out


def _params(code: str, at: int) -> list[str]:
    open_ = code.find("(", at)
    if open_ < 0:
        return []
    depth = 0
    for k in range(open_, min(len(code), open_ + 4000)):
        depth += {"(": 1, ")": -1}.get(code[k], 0)
        if not depth:
            out = []
            for part in re.split(r",(?![^<(\[]*[>)\]])", code[open_ + 1 : k]):
                words = re.findall(ID, part.split("=")[0].split(":")[0])
                if words:
                    out.append(words[0] if ":" in part else words[-1])
            return out
    return []


def parse_code(lang: Language, path: str, source: str) -> dict:
    code, notes = mask(source, lang)
    taken: list[tuple[int, int]] = []
    classes: dict[str, dict] = {}
    spans: list[tuple[int, int, str]] = []
    for rx in lang.types:
        for m in re.finditer(rx, code, re.M):
            got = m.groupdict()
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            body, end = brace_end(code, start) if lang.block == "lua" else body_of(code, start, lang)
            name = got["name"]
            bases = _names(got.get("bases"))
            if name in classes and got.get("impl") is not None:
                classes[name]["bases"] += [b for b in bases if b not in classes[name]["bases"]]
            elif name not in classes:
                classes[name] = klass(name, source, start, end, bases)
            if body >= 0:
                spans.append((body, end, name))
    functions: list[dict] = []

    def inside(at: int) -> str | None:
        own = [s for s in spans if s[0] < at < s[1]]
        return max(own)[2] if own else None

    def add(m: re.Match, owner: str | None) -> None:
        name = m["name"]
        if name in NOT_NAMES:
            return
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        body, end = body_of(code, start, lang)
        if any(a <= start < b and not (owner and any(a < s[0] and s[1] <= b for s in spans)) for a, b in taken):
            nested = True
        else:
            nested = False
        if nested and owner:
            return
        taken.append((start + 1, end))
        made = function(
            name, source, start, end, calls_in(code, body if body >= 0 else m.end(), end, lang, source),
            args=_params(code, m.start("name")), is_nested=nested, is_async="async" in m[0].split(name)[0].split(),
            is_test=name.lower().startswith("test"),
        )
        if owner and owner in classes:
            classes[owner]["methods"].append(made)
        elif owner:
            classes[owner] = klass(owner, source, start, end, [], [made])
        else:
            functions.append(made)

    seen: set[int] = set()
    for rx in lang.functions:
        for m in re.finditer(rx, code, re.M):
            if m.start("name") not in seen:
                seen.add(m.start("name"))
                add(m, m.groupdict().get("owner") or inside(m.start("name")))
    for rx in lang.methods:
        for m in re.finditer(rx, code, re.M):
            if m.start("name") not in seen and inside(m.start("name")):
                seen.add(m.start("name"))
                add(m, inside(m.start("name")))
    for c in classes.values():
        c["methods"] = unique(sorted(c["methods"], key=lambda f: f["line_start"]), "name", "line_start")
    imports = []
    for rx in lang.imports:
        for m in re.finditer(rx, source, re.M):
            if code[m.start() : m.end()].strip():  # not within a comment
                got = m.groupdict()
                names = [n.split(" as ")[0].strip() for n in (got.get("names") or "").split(",") if n.strip()]
                imports.append(imported(got["module"].strip(), line_at(source, m.start("module")), names, got.get("alias")))
    variables = []
    for rx in lang.variables:
        for m in re.finditer(rx, code, re.M):
            at = m.start("name")
            if not any(a < at < b for a, b in taken) and m["name"] not in lang.words | COMMON_WORDS:
                value = m.groupdict().get("value")
                variables.append(variable(m["name"], line_at(source, at), source[m.start("value") : m.end("value")].strip() if value else None))
    comments = [c for at, text in notes for c in comment(text, line_at(source, at))]
    return result(
        path,
        functions=sorted(functions, key=lambda f: f["line_start"]),
        classes=sorted(classes.values(), key=lambda c: c["line_start"]),
        imports=sorted(unique(imports, "module", "line"), key=lambda i: i["line"]),
        variables=sorted(unique(variables, "name"), key=lambda v: v["line"]),
        comments=comments,
    )


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|partial|readonly|export|default|declare|data|inline|suspend|extern|unsafe|const|synchronized|native|strictfp|fileprivate|mutating|required|convenience|lateinit|operator|pub(?:\([^)]*\))?)\s+)*"
_TYPE = r"[\w$.:<>\[\],?*&\s]+?"
_BASES = r"(?:\s*(?::|extends|implements)\s*(?P<bases>[^{;\n]+(?:\n\s+[^{;]*?)?))?"
_JS = Language(
    types=(rf"^[ \t]*{_MODS}class\s+(?P<name>{ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<bases>[^{{]+))?\s*(?=\{{)",),
    functions=(
        rf"^[ \t]*{_MODS}function\s*\*?\s*(?P<name>{ID})\s*\(",
        rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{ID})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|{ID}\s*=>)",
        rf"^[ \t]*(?:module\.)?exports\.(?P<name>{ID})\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>)",
    ),
    methods=(rf"^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?#?(?P<name>{ID})\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?::[^{{;\n]+)?(?=\{{)",),
    imports=(
        r"""^[ \t]*import\s+(?:type\s+)?(?:(?:\w+\s*,\s*)?\{(?P<names>[^}]*)\}\s*from\s*|[\w$*\s,]+?\s+from\s*)?["'](?P<module>[^"'\n]+)["']""",
        r"""\brequire\(\s*["'](?P<module>[^"'\n]+)["']\s*\)""",
        r"""^[ \t]*export\s+[^;\n]*?from\s*["'](?P<module>[^"'\n]+)["']""",
    ),
    variables=(rf"^(?:export\s+)?(?:const|let|var)\s+(?P<name>{ID})\s*(?::[^=\n]+)?=\s*(?!(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|{ID}\s*=>))(?P<value>[^;\n]*)",),
    strings=STRINGS + r"|`(?:\\.|[^`\\])*`",
    words=frozenset("import export of delete void instanceof".split()),
)

LANGUAGES: dict[str, tuple[Language, tuple[str, ...]]] = {
    "c1": (
        Language(
            types=(rf"^[ \t]*(?:typedef\s+)?(?:struct|union|enum)\s+(?P<name>{ID})\s*(?=\{{)",),
            functions=(rf"^(?!\s)(?!(?:typedef|else|return|struct\s+\w+\s*\{{))[\w][\w\s*]*?[\s*](?P<name>{ID})\s*\([^;{{}}]*\)\s*(?=\{{)",),
            imports=(r"^[ \t]*#[ \t]*include[ \t]*[<\"](?P<module>[^>\"\n]+)[>\"]",),
            variables=(rf"^(?!typedef|return|struct\s+\w+\s*\{{)(?:(?:static|const|extern|unsigned|struct)\s+)*[A-Za-z_]\w*[\s*]+(?P<name>{ID})(?:\[[^\]\n]*\])?\s*(?:=\s*(?P<value>[^;\n]+))?;", rf"^[ \t]*#[ \t]*define[ \t]+(?P<name>{ID})(?!\()[ \t]*(?P<value>[^\n]*)"),
        ),
        ("*.c", "*.h"),
    ),
    "cpp17": (
        Language(
            types=(rf"^[ \t]*(?:template\s*<[^;{{]*>\s*)?(?:class|struct)\s+(?P<name>{ID})(?:\s+final)?(?:\s*:\s*(?P<bases>[^{{;]+))?\s*(?=\{{)",),
            functions=(rf"^[ \t]*(?:template\s*<[^;{{]*>\s*)?(?:(?:virtual|static|inline|explicit|constexpr|friend)\s+)*[\w:<>,*&\s~]*?(?:(?P<owner>{ID})::)?~?(?P<name>{ID})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{{;]*)?(?=\{{)",),
            imports=(r"^[ \t]*#[ \t]*include[ \t]*[<\"](?P<module>[^>\"\n]+)[>\"]", r"^[ \t]*using\s+namespace\s+(?P<module>[\w:]+)"),
            variables=(rf"^(?!using|return|typedef|class|struct|namespace|template)(?:(?:static|const|constexpr|extern|inline)\s+)*[A-Za-z_][\w:<>]*[\s*&]+(?P<name>{ID})\s*(?:=\s*(?P<value>[^;\n]+))?;",),
        ),
        ("*.cpp", "*.hpp", "*.cc", "*.h", "*.cxx", "*.hxx"),
    ),
    "csharp12": (
        Language(
            types=(rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}(?:class|struct|record(?:\s+(?:class|struct))?|interface|enum)\s+(?P<name>{ID})(?:<[^>{{]*>)?(?:\([^)]*\))?(?:\s*:\s*(?P<bases>[^{{;]+?))?\s*(?=\{{|;)",),
            methods=(rf"^[ \t]*{_MODS}(?:{_TYPE}\s+)?(?P<name>{ID})\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?:where[^{{]*)?(?=\{{|=>)",),
            imports=(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;",),
            variables=(rf"^[ \t]+{_MODS}[\w<>\[\]?,.]+\s+(?P<name>{ID})\s*(?:=\s*(?P<value>[^;\n]+))?;",),
            words=frozenset("using lock foreach nameof when get set".split()),
        ),
        ("*.cs",),
    ),
    "go1": (
        Language(
            types=(rf"^type\s+(?P<name>{ID})\s+(?:struct|interface)\s*(?=\{{)",),
            functions=(rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<owner>{ID})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{ID})\s*\(", rf"^func\s+(?P<name>{ID})\s*(?:\[[^\]]*\])?\("),
            imports=(r"^import\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[^\"\n]+)\"", r"^\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[\w./-]+)\"\s*$"),
            variables=(rf"^(?:var|const)\s+(?P<name>{ID})(?:\s+[\w\[\]*.]+)?\s*(?:=\s*(?P<value>[^\n]*))?",),
            strings=STRINGS + r"|`[^`]*`",
            words=frozenset("select go defer range make len cap append panic print println".split()),
        ),
        ("*.go",),
    ),
    "java17": (
        Language(
            types=(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:class|interface|enum|record|@interface)\s+(?P<name>{ID})(?:<[^{{]*?>)?(?:\([^)]*\))?(?:\s+(?:extends|implements|permits)\s+(?P<bases>[^{{]+))?\s*(?=\{{)",),
            methods=(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^>\n]+>\s*)?(?:[\w.$<>\[\],?]+\s+)?(?P<name>{ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{)",),
            imports=(r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;",),
            variables=(rf"^[ \t]+(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w.<>\[\],?]+\s+(?P<name>{ID})\s*(?:=\s*(?P<value>[^;\n]+))?;",),
            words=frozenset("synchronized assert try".split()),
        ),
        ("*.java",),
    ),
    "javascript1": (_JS, ("*.js", "*.jsx", "*.mjs")),
    "kotlin2": (
        Language(
            types=(rf"^[ \t]*(?:@\w+\s*)*{_MODS}(?:enum\s+|annotation\s+|value\s+|fun\s+)?(?:class|interface|object)\s+(?P<name>{ID})(?:<[^>{{]*>)?(?:\s*(?:private\s+)?(?:constructor)?\([^)]*\))?(?:\s*:\s*(?P<bases>[^{{\n]+))?",),
            functions=(rf"^[ \t]*(?:@\w+\s*)*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>{ID})\s*\(",),
            imports=(r"^[ \t]*import\s+(?P<module>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?",),
            variables=(rf"^(?:(?:private|public|internal|const|lateinit)\s+)*(?:val|var)\s+(?P<name>{ID})(?:\s*:[^=\n]+)?(?:\s*=\s*(?P<value>[^\n]*))?",),
            strings=r"\"\"\"[\s\S]*?\"\"\"|" + STRINGS, words=frozenset("when constructor init".split()),
        ),
        ("*.kt", "*.kts"),
    ),
    "node20": (_JS, ("*.js", "*.mjs", "*.cjs")),
    "php8": (
        Language(
            types=(rf"^[ \t]*{_MODS}(?:class|interface|trait|enum)\s+(?P<name>{ID})(?:\s*:\s*\w+)?(?:\s+(?:extends|implements)\s+(?P<bases>[^{{]+))?\s*(?=\{{)",),
            functions=(rf"^[ \t]*{_MODS}function\s+&?(?P<name>{ID})\s*\(",),
            imports=(r"^[ \t]*use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*[\"'](?P<module>[^\"'\n]+)[\"']"),
            variables=(r"^[ \t]*(?:(?:public|private|protected|static|readonly|var)\s+)*(?:\??[\w\\]+\s+)?\$(?P<name>\w+)\s*=\s*(?P<value>[^;\n]+);", rf"^[ \t]*{_MODS}const\s+(?P<name>{ID})\s*=\s*(?P<value>[^;\n]+);"),
            comments=C_COMMENT + r"|#(?!\[)[^\n]*", words=frozenset("array isset empty echo print list foreach elseif require include require_once include_once match fn".split()),
        ),
        ("*.php",),
    ),
    "rust1": (
        Language(
            types=(
                rf"^[ \t]*(?:#\[[^\]]*\]\s*)*{_MODS}(?:struct|enum|trait|union)\s+(?P<name>{ID})(?:<[^>{{;(]*>)?(?:\s*:\s*(?P<bases>[^{{;]+))?",
                rf"^[ \t]*(?:unsafe\s+)?(?P<impl>impl)\b(?:\s*<[^{{]*?>)?\s+(?:(?P<bases>[\w:<>, ]+?)\s+for\s+)?(?P<name>{ID})(?:<[^{{]*?>)?[^{{;]*(?=\{{)",
            ),
            functions=(rf"^[ \t]*(?:#\[[^\]]*\]\s*)*{_MODS}fn\s+(?P<name>{ID})\s*(?:<[^(]*>)?\(",),
            imports=(r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+?)(?:::\{(?P<names>[^}]*)\})?(?:\s+as\s+(?P<alias>\w+))?\s*;", r"^[ \t]*extern\s+crate\s+(?P<module>\w+)", r"^[ \t]*(?:pub\s+)?mod\s+(?P<module>\w+)\s*;"),
            variables=(rf"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>{ID})\s*:[^=\n]+=\s*(?P<value>[^;\n]+)",),
            strings=r"r#*\"[\s\S]*?\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", words=frozenset("match loop impl mod unsafe Some None Ok Err".split()),
        ),
        ("*.rs",),
    ),
    "swift5": (
        Language(
            types=(rf"^[ \t]*(?:@\w+\s*)*{_MODS}(?:class|struct|enum|protocol|actor|extension)\s+(?P<name>{ID})(?:<[^>{{]*>)?(?:\s*:\s*(?P<bases>[^{{]+))?\s*(?=\{{)",),
            functions=(rf"^[ \t]*(?:@\w+\s*)*{_MODS}(?:class\s+)?func\s+(?P<name>{ID})\s*(?:<[^>(]*>)?\(", r"^[ \t]*(?:(?:public|private|override|required|convenience)\s+)*(?P<name>init)[?!]?\s*\("),
            imports=(r"^[ \t]*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?(?P<module>[\w.]+)",),
            variables=(rf"^(?:(?:public|private|static|fileprivate|internal)\s+)*(?:let|var)\s+(?P<name>{ID})(?:\s*:[^=\n{{]+)?(?:\s*=\s*(?P<value>[^\n]*))?",),
            strings=r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"", words=frozenset("guard where".split()),
        ),
        ("*.swift",),
    ),
    "typescript1": (
        Language(
            types=(_JS.types[0], rf"^[ \t]*{_MODS}(?:abstract\s+)?class\s+(?P<name>{ID})(?:<[^{{]*?>)?(?:\s+(?:extends|implements)\s+(?P<bases>[^{{]+))?\s*(?=\{{)", rf"^[ \t]*{_MODS}interface\s+(?P<name>{ID})(?:<[^{{]*?>)?(?:\s+extends\s+(?P<bases>[^{{]+))?\s*(?=\{{)"),
            functions=_JS.functions, methods=_JS.methods, imports=_JS.imports,
            variables=(*_JS.variables, rf"^(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{ID})(?:<[^=\n]*>)?\s*=\s*(?P<value>[^;\n]*)", rf"^(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{ID})"),
            strings=_JS.strings, words=_JS.words,
        ),
        ("*.ts", "*.tsx"),
    ),
    "dart3": (
        Language(
            types=(rf"^[ \t]*(?:(?:abstract|base|final|sealed|interface|mixin)\s+)*(?:class|mixin|enum|extension)\s+(?P<name>{ID})(?:<[^>{{]*>)?(?:\s+(?:extends|implements|with|on)\s+(?P<bases>[^{{]+))?\s*(?=\{{)",),
            functions=(rf"^(?:[\w<>?,.\[\]]+\s+)?(?P<name>{ID})\s*\([^;{{}}]*\)\s*(?:async\*?|sync\*)?\s*(?=\{{|=>)",),
            methods=(rf"^[ \t]+(?:(?:static|external|@override|factory|const)\s+)*(?:[\w<>?,.\[\]]+\s+)?(?P<name>{ID})\s*\([^;{{}}]*\)\s*(?:async\*?|sync\*)?\s*(?=\{{|=>)",),
            imports=(r"^[ \t]*(?:import|export|part)\s+[\"'](?P<module>[^\"'\n]+)[\"'](?:\s+as\s+(?P<alias>\w+))?",),
            variables=(rf"^(?:(?:final|const|var|late)\s+)+(?:[\w<>?,.]+\s+)?(?P<name>{ID})\s*=\s*(?P<value>[^;\n]+);", rf"^(?:int|double|String|bool|num|List<[^>]*>|Map<[^>]*>)\??\s+(?P<name>{ID})\s*(?:=\s*(?P<value>[^;\n]+))?;"),
            words=frozenset("assert rethrow".split()),
        ),
        ("*.dart",),
    ),
    "scala3": (
        Language(
            types=(rf"^[ \t]*(?:(?:sealed|abstract|final|case|implicit|private|protected)\s+)*(?:class|trait|object|enum)\s+(?P<name>{ID})(?:\[[^\]]*\])?(?:\s*\([^)]*\))*(?:\s+extends\s+(?P<bases>[^{{\n:]+))?",),
            functions=(rf"^[ \t]*(?:(?:override|private|protected|final|implicit|inline|given)\s+)*def\s+(?P<name>{ID})",),
            imports=(r"^[ \t]*import\s+(?P<module>[\w.]+?)(?:\.\{(?P<names>[^}]*)\})?\s*$", r"^[ \t]*import\s+(?P<module>[\w.*]+)"),
            variables=(rf"^[ \t]*(?:(?:private|protected|final|lazy|implicit|override)\s+)*(?:val|var)\s+(?P<name>{ID})(?:\s*:[^=\n]+)?\s*=\s*(?P<value>[^\n]*)",),
            strings=r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"", words=frozenset("match".split()),
        ),
        ("*.scala",),
    ),
    "shell1": (
        Language(
            functions=(r"^[ \t]*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\s*\)\s*(?=\{)", r"^[ \t]*function\s+(?P<name>[A-Za-z_][\w-]*)\s*(?=\{)"),
            imports=(r"^[ \t]*(?:source|\.)[ \t]+[\"']?(?P<module>[^\s\"';]+)",),
            variables=(r"^[ \t]*(?:(?:export|readonly|local|declare(?:[ \t]+-\w+)?)[ \t]+)?(?P<name>[A-Za-z_]\w*)=(?P<value>[^\n;]*)",),
            comments=r"(?<![\w$\\{])#[^\n]*", bare_calls=True, words=frozenset("echo cd exit set local export test read shift eval exec trap unset".split()),
        ),
        ("*.sh", "*.bash"),
    ),
    "powershell7": (
        Language(
            types=(rf"(?i)^[ \t]*class\s+(?P<name>{ID})(?:\s*:\s*(?P<bases>[^{{]+))?\s*(?=\{{)",),
            functions=(r"(?i)^[ \t]*(?:function|filter)\s+(?:\w+:)?(?P<name>[A-Za-z_][\w-]*)",),
            imports=(r"(?im)^[ \t]*\.[ \t]+[\"']?(?P<module>[^\s\"']+)", r"(?im)^[ \t]*Import-Module[ \t]+[\"']?(?P<module>[^\s\"']+)", r"(?im)^[ \t]*using[ \t]+module[ \t]+(?P<module>\S+)"),
            variables=(r"^[ \t]*(?:\[[\w.\[\]]+\])?\$(?:\w+:)?(?P<name>\w+)\s*=\s*(?P<value>[^\n]*)",),
            comments=r"<#[\s\S]*?#>|#[^\n]*", bare_calls=True, words=frozenset("param begin process end foreach elseif Write-Host Write-Output".split()),
        ),
        ("*.ps1",),
    ),
    "r1": (
        Language(
            functions=(r"^[ \t]*(?P<name>[A-Za-z_.][\w.]*)\s*(?:<-|=)\s*function\s*\(",),
            imports=(r"\b(?:library|require)\(\s*[\"']?(?P<module>[\w.]+)", r"\bsource\(\s*[\"'](?P<module>[^\"'\n]+)"),
            variables=(r"^(?P<name>[A-Za-z_.][\w.]*)\s*(?:<-|=)\s*(?!function\b)(?P<value>[^\n]*)",),
            comments=HASH_COMMENT, words=frozenset("library require source c list print cat paste repeat".split()),
        ),
        ("*.R", "*.r"),
    ),
    "ruby3": (
        Language(
            types=(r"^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*(?:::\w+)*)(?:\s*<\s*(?P<bases>[\w:]+))?",),
            functions=(r"^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)",),
            imports=(r"^[ \t]*(?:require|require_relative|load)\s*\(?\s*[\"'](?P<module>[^\"'\n]+)[\"']", r"^[ \t]*(?:include|extend)\s+(?P<module>[A-Z][\w:]*)"),
            variables=(r"^(?P<name>[A-Z][A-Z0-9_]*|\$\w+|[a-z_]\w*)\s*=(?![=~>])\s*(?P<value>[^\n]*)",),
            comments=r"^=begin[\s\S]*?^=end|#(?!\{)[^\n]*", block="ruby", bare_calls=True,
            words=frozenset("puts print p raise require attr_reader attr_accessor attr_writer private public protected begin rescue ensure unless until class module then".split()),
        ),
        ("*.rb",),
    ),
    "lua5": (
        Language(
            types=(r"^(?:local\s+)?(?P<name>[A-Z]\w*)\s*=\s*(?:setmetatable\s*\(\s*)?(?=\{)",),
            functions=(r"^[ \t]*(?:local\s+)?function\s+(?:(?P<owner>[A-Za-z_]\w*)[.:])?(?P<name>[A-Za-z_]\w*)\s*\(", r"^[ \t]*(?:local\s+)?(?P<name>[A-Za-z_]\w*)\s*=\s*function\s*\("),
            imports=(r"\brequire\s*\(?\s*[\"'](?P<module>[^\"'\n]+)[\"']",),
            variables=(r"^(?:local\s+)?(?P<name>[A-Za-z_]\w*)\s*=(?!=)\s*(?!function\b)(?P<value>[^\n]*)",),
            comments=r"--\[\[[\s\S]*?\]\]|--[^\n]*", block="lua", words=frozenset("require end then elseif until repeat local".split()),
        ),
        ("*.lua",),
    ),
    "elixir1": (
        Language(
            types=(r"^[ \t]*def(?:module|protocol|impl)\s+(?P<name>[A-Z][\w.]*)",),
            functions=(r"^[ \t]*def(?:p|macro|macrop)?\s+(?P<name>[a-z_]\w*[?!]?)",),
            imports=(r"^[ \t]*(?:import|alias|require|use)\s+(?P<module>[A-Z][\w.]*)(?:,\s*as:\s*(?P<alias>\w+))?",),
            variables=(r"^[ \t]*@(?P<name>[a-z_]\w*)\s+(?P<value>[^\n]+)", r"^(?P<name>[a-z_]\w*)\s*=(?!=)\s*(?P<value>[^\n]*)"),
            strings=r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"", comments=HASH_COMMENT, block="elixir", words=frozenset("defmodule do end cond case with unless".split()),
        ),
        ("*.ex", "*.exs"),
    ),
}

_IGNORED = {
    "go1": ("vendor",),
    "rust1": ("target",),
    "javascript1": ("node_modules", "bower_components"),
    "typescript1": ("node_modules",),
    "java17": ("target", ".gradle"),
}


def parsers() -> list[Parser]:
    return [
        Parser(name, names, lambda path, source, lang=lang: parse_code(lang, path, source), ignore_dirs=_IGNORED.get(name, ()))
        for name, (lang, names) in LANGUAGES.items()
    ]
