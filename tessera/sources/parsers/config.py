"""Parsers of configuration, build and data files."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET

from tessera.sources.parsers.base import Parser, comment, function, imported, klass, line_at, line_starts, result, unique, variable


def _rx(pattern: str, source: str, flags: int = re.M) -> list[re.Match]:
    return list(re.finditer(pattern, source, flags))


def _hash_comments(source: str, marks: str = "#") -> list[dict]:
    return [c for n, _, t in line_starts(source) if t.lstrip()[:1] and t.lstrip()[0] in marks for c in comment(t, n)]


def _vars(pattern: str, source: str) -> list[dict]:
    out = [
        variable(m["name"].strip(), line_at(source, m.start("name")), (m.groupdict().get("value") or "").strip() or None)
        for m in _rx(pattern, source)
    ]
    return unique(out, "name", "line")


def _mods(pattern: str, source: str, flags: int = re.M) -> list[dict]:
    return unique([imported(m["module"].strip(), line_at(source, m.start("module"))) for m in _rx(pattern, source, flags)], "module", "line")


def parse_env(path: str, source: str) -> dict:
    return result(path, variables=_vars(r"^[ \t]*(?:export[ \t]+)?(?P<name>[A-Za-z_]\w*)[ \t]*=(?P<value>[^\n]*)", source), comments=_hash_comments(source))


def parse_properties(path: str, source: str) -> dict:
    return result(path, variables=_vars(r"^[ \t]*(?![#!\s])(?P<name>[^\s=:]+)[ \t]*[=:][ \t]*(?P<value>[^\n]*)", source), comments=_hash_comments(source, "#!"))


def parse_editorconfig(path: str, source: str) -> dict:
    sections = [klass(m["name"], source, m.start(), m.end()) for m in _rx(r"^\[(?P<name>[^\]\n]+)\]", source)]
    return result(path, classes=sections, variables=_vars(r"^[ \t]*(?![#;\[\s])(?P<name>[\w-]+)[ \t]*=[ \t]*(?P<value>[^\n]*)", source), comments=_hash_comments(source, "#;"))


def parse_gitignore(path: str, source: str) -> dict:
    return result(path, variables=[variable(t.strip(), n) for n, _, t in line_starts(source) if t.strip() and not t.startswith("#")], comments=_hash_comments(source))


def parse_makefile(path: str, source: str) -> dict:
    functions = []
    heads = _rx(r"^(?P<name>[A-Za-z0-9_./%$(){}-]+(?:[ \t]+[A-Za-z0-9_./%-]+)*)[ \t]*::?(?!=)[ \t]*(?P<deps>[^\n=]*)$", source)
    for m in heads:
        body = re.compile(r"(?:\n(?:\t[^\n]*|[ \t]*(?=\n)))*").match(source, m.end())
        line = line_at(source, m.start())
        calls = [{"name": d, "args": [], "line": line} for d in m["deps"].split("#")[0].split() if d != "|"]
        functions.append(function(m["name"], source, m.start(), body.end(), calls))
    return result(path, functions=functions, imports=_mods(r"^-?s?include[ \t]+(?P<module>[^\n#]+)", source), variables=_vars(r"^(?:export[ \t]+|override[ \t]+)?(?P<name>[A-Za-z_][\w.-]*)[ \t]*(?:\?|:{1,3}|\+|!)?=[ \t]*(?P<value>[^\n]*)", source), comments=_hash_comments(source))


def parse_cmake(path: str, source: str) -> dict:
    functions, linked = [], {}
    for m in _rx(r"\btarget_link_libraries\s*\(\s*(?P<name>[\w.-]+)\s+(?P<libs>[^)]*)\)", source, re.I):
        line = line_at(source, m.start())
        words = [w for w in m["libs"].split() if w not in ("PUBLIC", "PRIVATE", "INTERFACE")]
        linked.setdefault(m["name"], []).extend({"name": w, "args": [], "line": line} for w in words)
    for m in _rx(r"\b(?:add_executable|add_library|add_custom_target)\s*\(\s*(?P<name>[\w.-]+)[^)]*\)", source, re.I):
        functions.append(function(m["name"], source, m.start(), m.end(), linked.get(m["name"], [])))
    for m in _rx(r"\b(?:function|macro)\s*\(\s*(?P<name>[\w.-]+)[^)]*\)[\s\S]*?\bend(?:function|macro)\s*\([^)]*\)", source, re.I):
        functions.append(function(m["name"], source, m.start(), m.end()))
    return result(path, functions=functions, imports=_mods(r"\b(?:include|find_package|add_subdirectory)\s*\(\s*(?P<module>[^\s)]+)", source, re.I), variables=_vars(r"\b(?:set|option|SET|OPTION)\s*\(\s*(?P<name>[\w.-]+)\s*(?P<value>[^)]*)\)", source), comments=_hash_comments(source))


def parse_dockerfile(path: str, source: str) -> dict:
    flat = re.sub(r"\\\n", lambda m: "  ", source)  # continuations stay as long as they were; lines are counted in source
    stages, functions = [], []
    froms = _rx(r"^[ \t]*FROM[ \t]+(?:--\S+[ \t]+)?(?P<module>\S+)(?:[ \t]+AS[ \t]+(?P<name>\S+))?", flat, re.M | re.I)
    for k, m in enumerate(froms):
        end = froms[k + 1].start() if k + 1 < len(froms) else len(source)
        if m["name"]:
            stages.append(klass(m["name"], source, m.start(), end, [m["module"]]))
    for k, m in enumerate(_rx(r"^[ \t]*(?P<what>RUN|CMD|ENTRYPOINT)[ \t]+[^\n]*", flat, re.M | re.I), 1):
        functions.append(function(f"{m['what'].lower()}_{k}", source, m.start(), m.end()))
    images = [imported(m["module"], line_at(source, m.start())) for m in froms]
    return result(path, functions=functions, classes=stages, imports=images, variables=_vars(r"^[ \t]*(?:ENV|ARG|env|arg)[ \t]+(?P<name>[A-Za-z_]\w*)(?:[ \t]*=?[ \t]*(?P<value>[^\n]*))?", flat), comments=_hash_comments(source))


def parse_gradle(path: str, source: str) -> dict:
    deps = _mods(r"""\b(?:implementation|api|compileOnly|runtimeOnly|testImplementation|classpath|kapt|annotationProcessor)\s*\(?\s*["'](?P<module>[^"'\n]+)["']""", source)
    plugins = _mods(r"""^[ \t]*(?:id|apply plugin:)\s*\(?\s*["'](?P<module>[^"'\n]+)["']""", source)
    tasks = []
    for m in _rx(r"""\btask(?:s\.register)?\s*(?:\(\s*["'])?\s*(?P<name>[A-Za-z_]\w*)[^{\n]*(?P<open>\{)?""", source):
        tasks.append(function(m["name"], source, m.start(), m.end()))
    return result(path, functions=tasks, imports=deps + plugins, variables=_vars(r"^[ \t]*(?:def|val|var|ext\.)?[ \t]*(?P<name>[A-Za-z_][\w.]*)[ \t]*=[ \t]*(?P<value>[^\n{]+)", source))


def _indented(source: str) -> list[tuple[int, int, str, str]]:
    """(line, indent, key, value) of each "key: value" line of a YAML-like text; list markers count as indent."""
    out = []
    for n, _, t in line_starts(source):
        m = re.match(r"^([ ]*(?:- +)*)(\"[^\"]+\"|'[^']+'|[^\s#:'\"{\[][^:#]*?)\s*:(?:\s+(.*?))?\s*$", t)
        if m:
            value = re.sub(r"\s+#.*$", "", m[3] or "").strip().strip("\"'")
            out.append((n, len(m[1]), m[2].strip("\"'"), value))
    return out


def _at_line(source: str, n: int) -> tuple[int, int]:
    _, at, text = line_starts(source)[n - 1]
    return at, at + len(text)


def _block(rows: list[tuple[int, int, str, str]], k: int, source: str) -> tuple[int, list]:
    """The last line and the rows under row k."""
    n, indent, _, _ = rows[k]
    under = []
    for r in rows[k + 1 :]:
        if r[1] <= indent:
            return r[0] - 1, under
        under.append(r)
    return source.count("\n") + 1, under


def parse_compose(path: str, source: str) -> dict:
    rows = _indented(source)
    services, images, volumes, calls_of = [], [], [], {}
    for k, (n, indent, key, _) in enumerate(rows):
        if indent == 0 and key in ("services", "volumes", "networks"):
            _, under = _block(rows, k, source)
            level = min((r[1] for r in under), default=0)
            for r in under:
                if r[1] != level:
                    continue
                if key != "services":
                    volumes.append(variable(r[2], r[0]))
                    continue
                j = rows.index(r)
                last, inner = _block(rows, j, source)
                start, end = _at_line(source, r[0])[0], _at_line(source, last)[1]
                text = source[start:end]
                images += [imported(x[3], x[0]) for x in inner if x[2] == "image" and x[3]]
                needs = re.search(r"depends_on:\s*(\[[^\]]*\]|(?:\n\s*(?:- )?[\w-]+:?[^\n]*)+)", text)
                names = [w for w in re.findall(r"[\w-]+", needs[1]) if w not in ("condition", "service_healthy", "service_started", "-")] if needs else []
                calls_of[r[2]] = [{"name": x, "args": [], "line": r[0]} for x in names]
                made = function(r[2], source, start, end, calls_of[r[2]])
                services.append(klass(r[2], source, start, end, [], [made] if names else []))
    return result(path, classes=services, imports=images, variables=volumes, comments=_hash_comments(source))


def parse_workflow(path: str, source: str) -> dict:
    rows = _indented(source)
    jobs, variables = [], [variable(k, n, v) for n, i, k, v in rows if i == 0]
    for k, r in enumerate(rows):
        if r[1] == 0 and r[2] == "jobs":
            _, under = _block(rows, k, source)
            level = min((x[1] for x in under), default=0)
            for x in under:
                if x[1] == level:
                    last, inner = _block(rows, rows.index(x), source)
                    start, end = _at_line(source, x[0])[0], _at_line(source, last)[1]
                    needs = [w for y in inner if y[2] == "needs" for w in re.findall(r"[\w-]+", y[3])]
                    jobs.append(function(x[2], source, start, end, [{"name": w, "args": [], "line": x[0]} for w in needs]))
    uses = [imported(v, n) for n, _, k, v in rows if k == "uses" and v]
    return result(path, functions=jobs, imports=uses, variables=variables)


def parse_manifest(path: str, source: str) -> dict:
    """Each document of a cluster manifest: workloads are classes."""
    classes, images, variables = [], [], []
    first = 1
    for doc in re.split(r"(?m)^---\s*$", source):
        rows = [(n + first - 1, i, k, v) for n, i, k, v in _indented(doc)]
        kind = next((v for _, i, k, v in rows if i == 0 and k == "kind"), "")
        name = next((v for _, _, k, v in rows if k == "name" and v), "")
        if kind and name:
            line = rows[0][0]
            classes.append({"name": f"{kind}/{name}", "line_start": line, "line_end": first + doc.count("\n"), "source": doc.strip("\n"), "bases": [], "methods": []})
        images += [imported(v, n) for n, _, k, v in rows if k == "image" and v]
        if kind in ("ConfigMap", "Secret"):
            for k, r in enumerate(rows):
                if r[1] == 0 and r[2] in ("data", "stringData"):
                    for x in rows[k + 1 :]:
                        if x[1] <= r[1]:
                            break
                        variables.append(variable(x[2], x[0], x[3]))
        variables += [variable(m[1].strip("\"'"), first + doc.count("\n", 0, m.start())) for m in re.finditer(r"-\s*name:\s*(\S+)\s*\n\s*value(?:From)?:", doc)]
        first += doc.count("\n")
    return result(path, classes=classes, imports=images, variables=unique(variables, "name", "line"))


def parse_yaml(path: str, source: str) -> dict:
    keys = [variable(k, n, v or None) for n, i, k, v in _indented(source) if i == 0]
    anchors = [variable(m["name"], line_at(source, m.start())) for m in _rx(r"(?<=[\s:])&(?P<name>[\w-]+)", source)]
    refs = _mods(r"!include\s+(?P<module>\S+)", source) + _mods(r"""^\s*(?:-\s*)?["']?\$?ref["']?:\s*["']?(?P<module>[^\s"']+)""", source)
    return result(path, variables=unique(keys + anchors, "name", "line"), imports=unique(refs, "module", "line"), comments=_hash_comments(source))


def parse_openapi(path: str, source: str) -> dict | None:
    if path.endswith(".json"):
        return parse_json(path, source)
    rows = _indented(source)
    out, top = [], ""
    for n, i, k, v in rows:
        top = k if i == 0 else top
        if k == "title" and top == "info" or top == "paths" and k.startswith("/"):
            out.append(variable(v if k == "title" else k, n))
    for k, r in enumerate(rows):
        if r[2] in ("schemas", "definitions"):
            _, under = _block(rows, k, source)
            level = min((x[1] for x in under), default=0)
            out += [variable(x[2], x[0]) for x in under if x[1] == level]
    refs = _mods(r"""\$ref["']?:\s*["']?(?P<module>[^\s"']+)""", source)
    return result(path, variables=out, imports=refs)


def _refs(value: object) -> list[str]:
    if isinstance(value, dict):
        own = [value["$ref"]] if isinstance(value.get("$ref"), str) else []
        return own + [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _key_line(source: str, key: str) -> int:
    at = source.find(json.dumps(key, ensure_ascii=False))
    return line_at(source, at) if at >= 0 else 1


def parse_json(path: str, source: str) -> dict | None:
    """Top-level keys and references; None for what isn't JSON."""
    try:
        data = json.loads(source)
    except ValueError:
        return None
    keys = [variable(k, _key_line(source, k)) for k in data] if isinstance(data, dict) else []
    return result(path, variables=keys, imports=[imported(r, 1) for r in dict.fromkeys(_refs(data))])


def parse_schema(path: str, source: str) -> dict | None:
    try:
        data = json.loads(source)
    except ValueError:
        return None
    if not isinstance(data, dict):
        return result(path)
    names = [data[k] for k in ("title", "$id") if isinstance(data.get(k), str)]
    for k in ("properties", "$defs", "definitions"):
        names += list(data[k]) if isinstance(data.get(k), dict) else []
    return result(path, variables=unique([variable(n, _key_line(source, n)) for n in names], "name"), imports=[imported(r, 1) for r in dict.fromkeys(_refs(data))])


def parse_toml(path: str, source: str) -> dict:
    try:
        data = tomllib.loads(source)
        keys = list(data)
        found = []
        for holder in (data, data.get("project", {}), data.get("tool", {}).get("poetry", {}) if isinstance(data.get("tool"), dict) else {}):
            for k in ("dependencies", "dev-dependencies"):
                d = holder.get(k) if isinstance(holder, dict) else None
                found += list(d) if isinstance(d, dict) else [re.split(r"[\s<>=!~;\[]", str(x))[0] for x in d or []]
    except tomllib.TOMLDecodeError:  # read what can be read
        keys = [m[1] for m in re.finditer(r"(?m)^\s*\[*([\w.-]+)\]*\s*(?:=|$)", source)]
        found = []
    lines = {k: next((n for n, _, t in line_starts(source) if re.match(rf"\s*\[*{re.escape(k)}\b", t)), 1) for k in keys}
    return result(path, variables=[variable(k, lines[k]) for k in dict.fromkeys(keys)], imports=[imported(d, 1) for d in dict.fromkeys(found)], comments=_hash_comments(source))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_xml(path: str, source: str) -> dict | None:
    try:
        root = ET.fromstring(source)
    except ET.ParseError:
        return None
    tags = list(dict.fromkeys(_local(x.tag) for x in root.iter() if isinstance(x.tag, str)))
    ids = [f"@{x.get('id')}" for x in root.iter() if x.get("id")]
    spaces = [m[1] for m in re.finditer(r"xmlns(?::\w+)?=\"(http[^\"]+)\"", source)]
    links = [x.get(k) for x in root.iter() for k in ("href", "{http://www.w3.org/1999/xlink}href") if x.get(k)]
    return result(path, variables=[variable(t, 1) for t in [*tags, *ids]], imports=[imported(m, 1) for m in dict.fromkeys(spaces + links)])


def parse_maven(path: str, source: str) -> dict | None:
    try:
        root = ET.fromstring(source)
    except ET.ParseError:
        return None
    child = {_local(x.tag): (x.text or "").strip() for x in root}
    variables = [variable(k, 1, child[k]) for k in ("groupId", "artifactId", "version", "packaging") if child.get(k)]
    for x in root.iter():
        if _local(x.tag) == "properties":
            variables += [variable(_local(p.tag), 1, (p.text or "").strip()) for p in x]
    deps = []
    for x in root.iter():
        if _local(x.tag) in ("dependency", "plugin", "parent"):
            got = {_local(c.tag): (c.text or "").strip() for c in x}
            if got.get("artifactId"):
                deps.append(imported(":".join(v for v in (got.get("groupId"), got["artifactId"]) if v), 1))
    return result(path, variables=variables, imports=unique(deps, "module"))


def parse_csv(path: str, source: str) -> dict:
    rows = list(csv.reader(io.StringIO(source)))
    head = [variable(h.strip(), 1) for h in rows[0] if h.strip()] if rows else []
    return result(path, variables=[*head, variable(f"_rows={max(0, len(rows) - 1)}", 1)] if rows else [])


def parse_terraform(path: str, source: str) -> dict:
    from tessera.sources.parsers.code import brace_end

    functions, classes, variables, imports = [], [], [], []
    for m in _rx(r"^[ \t]*(?P<kind>resource|data|variable|output|module|provider|locals|terraform)\b[ \t]*(?:\"(?P<a>[^\"]+)\")?[ \t]*(?:\"(?P<b>[^\"]+)\")?[ \t]*(?=\{)", source):
        _, end = brace_end(source, m.start())
        line = line_at(source, m.start())
        name = ".".join(x for x in (m["a"], m["b"]) if x)
        if m["kind"] == "resource":
            refs = unique([{"name": r, "args": [], "line": line} for r in re.findall(r"\b(?:[a-z]+_\w+\.\w+)", source[m.end() : end])], "name")
            functions.append(function(name, source, m.start(), end, refs))
        elif m["kind"] == "data":
            classes.append(klass(name, source, m.start(), end))
        elif m["kind"] in ("variable", "output"):
            variables.append(variable(name, line))
        elif m["kind"] == "module":
            at = re.search(r"\bsource\s*=\s*\"([^\"]+)\"", source[m.end() : end])
            imports.append(imported(at[1] if at else name, line))
    return result(path, functions=functions, classes=classes, variables=variables, imports=imports, comments=_hash_comments(source))


def parse_sql(path: str, source: str) -> dict:
    functions, classes = [], []
    name = r"[\"`\[]?(?P<name>[\w.]+)[\"`\]]?"
    for m in _rx(rf"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:FUNCTION|PROCEDURE|PROC)\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}", source, re.I):
        end = source.find(";", m.end())
        end = len(source) if end < 0 else end + 1
        used = dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|INTO)\s+[\"`\[]?([\w.]+)", source[m.end() : end], re.I))
        functions.append(function(m["name"], source, m.start(), end, [{"name": t, "args": [], "line": line_at(source, m.start())} for t in used]))
    for m in _rx(rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+)?(?:MATERIALIZED\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}", source, re.I):
        end = source.find(";", m.end())
        classes.append(klass(m["name"], source, m.start(), len(source) if end < 0 else end + 1))
    notes = [c for m in _rx(r"--[^\n]*|/\*[\s\S]*?\*/", source) for c in comment(m[0], line_at(source, m.start()))]
    return result(path, functions=functions, classes=classes, variables=_vars(r"\b(?:DECLARE|declare)\s+(?P<name>@?\w+)\s*(?P<value>[^;\n]*)", source), comments=notes)


def parsers() -> list[Parser]:
    yaml = ("*.yaml", "*.yml")
    return [
        Parser("cmake1", ("CMakeLists.txt", "*.cmake"), parse_cmake),
        Parser("csv1", ("*.csv",), parse_csv),
        Parser("docker_compose1", ("docker-compose*.yml", "docker-compose*.yaml", "compose.yml", "compose.yaml"), parse_compose),
        Parser("dockerfile1", ("Dockerfile", "dockerfile", "Dockerfile.*", "*.dockerfile"), parse_dockerfile),
        Parser("editorconfig1", (".editorconfig",), parse_editorconfig),
        Parser("env1", (".env", ".env.*", "*.env"), parse_env),
        Parser("github_actions1", yaml, parse_workflow, holds=(".github/workflows/",)),
        Parser("gitignore1", (".gitignore", "*.gitignore"), parse_gitignore),
        Parser("gradle1", ("*.gradle", "*.gradle.kts"), parse_gradle),
        Parser("json1", ("*.json",), parse_json),
        Parser("jsonschema", ("*.schema.json",), parse_schema),
        Parser("k8s_manifest1", yaml, parse_manifest, holds=("k8s", "manifest", "kubernetes")),
        Parser("makefile1", ("Makefile", "makefile", "GNUmakefile", "*.mk"), parse_makefile),
        Parser("maven1", ("pom.xml",), parse_maven),
        Parser("openapi3", ("*openapi*.yaml", "*openapi*.yml", "*swagger*.yaml", "*swagger*.yml", "*openapi*.json", "*swagger*.json"), parse_openapi),
        Parser("properties1", ("*.properties", "*.props"), parse_properties),
        Parser("sql1", ("*.sql",), parse_sql),
        Parser("terraform1", ("*.tf",), parse_terraform),
        Parser("toml1", ("*.toml",), parse_toml),
        Parser("xml1", ("*.xml",), parse_xml),
        Parser("yaml1", yaml, parse_yaml),
    ]
