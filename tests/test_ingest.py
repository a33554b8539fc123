"""File trees, parsers, saved graphs, updates and streams."""

from __future__ import annotations

import json
import os
import time

import pytest

from tessera.operators import changes
from tessera.plans import ingest
from tessera.plans.enrich import enriched
from tessera.plans.knowledge import KnowledgeGraph
from tessera.schema import EDGE, NODE, conform
from tessera.sources import files, store
from tessera.sources.parsers import dispatch, parse, registry, rows
from tessera.streaming import changes as stream
from tessera.streaming import events

TREE = {
    "pkg/__init__.py": "from pkg.a import f\n",
    "pkg/a.py": "import os\nfrom pkg.b import g, Base\n\ndef f(x: int = 1) -> int:\n    # TODO: more\n    return g(x)\n\nclass A(Base):\n    size: int = 3\n    def m(self):\n        return self.n() + f(2)\n    def n(self):\n        return 1\n",
    "pkg/b.py": "class Base:\n    pass\n\ndef g(x):\n    return x if x and x > 1 or x < 0 else 0\n",
    "tests/test_a.py": "from pkg.a import f\n\ndef test_f():\n    assert f(1)\n",
    "docs/x.md": "---\ntitle: The title\n---\n# One\nsee [two](y.md) and ![i](i.png)\n## Two\n- [x] done\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nf(1)\n```\n<!-- FIXME: later -->\n",
    "main.go": 'package main\n\nimport "fmt"\n\nfunc main() { fmt.Println(helper()) }\n\nfunc helper() int { return 1 }\n',
    "data.bin": "\x00\x01",
    "bad.py": "def broken(:\n",
    ".hidden/x.py": "x = 1\n",
    "venv1/pyvenv.cfg": "",
    "venv1/lib/y.py": "y = 1\n",
    "node_modules/z.js": "z()\n",
    "build/w.py": "w = 1\n",
    "a.pyc": "junk",
}


def write(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    return root


def edges(graph):
    return sorted((r["source"], r["target"], r["type"]) for r in graph.edges.collect())


def nodes(graph):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in graph.nodes.drop("abs_path").collect())


def test_listing_and_filters(spark, tree):
    found = files.listing(spark, str(tree))
    use = registry()
    kept = lambda f=None: sorted(r["rel_path"] for r in files.kept(found, use, f).collect())
    everything = ["bad.py", "data.bin", "docs/x.md", "main.go", "pkg/__init__.py", "pkg/a.py", "pkg/b.py", "tests/test_a.py"]
    assert kept() == everything
    assert kept(files.Filters(exclude_dirs=("pkg",))) == [p for p in everything if not p.startswith("pkg/")]
    assert kept(files.Filters("custom", include_dirs=("docs",))) == ["bad.py", "data.bin", "docs/x.md", "main.go"]
    assert kept(files.Filters(include_types=(".MD", "go"))) == ["docs/x.md", "main.go"]
    assert kept(files.Filters(exclude_globs=("*.py", "docs/*"))) == ["data.bin", "main.go"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert files.allowed(str(tree / "pkg"), [str(tree)]) and not files.allowed(str(tree / ".." / "x"), [str(tree)])


def test_build(spark, tree):
    index = ingest.build(spark, str(tree), tasks=2)
    g = index.graph
    told = {r["id"]: r for r in g.nodes.collect()}
    have = edges(g)
    assert {"dir::.", "dir::pkg", "file::pkg/a.py", "func::pkg/a.py::f", "method::pkg/a.py::A::m", "var::pkg/a.py::A::size", "doc::docs/x.md", "section::docs/x.md::L6", "file::data.bin", "file::bad.py"} <= set(told)
    for e in [
        ("dir::.", "dir::pkg", "contains"), ("dir::pkg", "file::pkg/a.py", "contains"), ("file::pkg/a.py", "func::pkg/a.py::f", "defines"),
        ("func::pkg/a.py::f", "func::pkg/b.py::g", "calls"), ("method::pkg/a.py::A::m", "func::pkg/a.py::f", "calls"),
        ("class::pkg/a.py::A", "class::pkg/b.py::Base", "inherits"), ("func::tests/test_a.py::test_f", "func::pkg/a.py::f", "calls"),
        ("func::main.go::main", "func::main.go::helper", "calls"),
    ]:
        assert e in have, e
    assert len({(a, b) for a, b, _ in have}) == len(have)
    f = told["func::pkg/a.py::f"]
    assert f["params"][0]["annotation"] == "int" and f["return_annotation"] == "int" and f["complexity"] == 1
    assert told["func::pkg/b.py::g"]["complexity"] == 1 + 0 + 2  # and, or
    assert told["doc::docs/x.md"]["title"] == "The title" and told["section::docs/x.md::L6"]["parent_section"] == "One"
    assert {r["parser"]: r["error"] for r in index.parsed.collect()}["python3"] is None
    assert index.stats["files_total"] == 8 and index.stats["strategy"] == "full"
    kg = KnowledgeGraph(g, index.parsed.select("rel_path").withColumnRenamed("rel_path", "path"))
    assert sorted(r["id"] for r in kg.callers("func::pkg/a.py::f").collect()) == ["func::tests/test_a.py::test_f", "method::pkg/a.py::A::m"]
    assert kg.function_source("pkg/b.py", "g").first()["source"].startswith("def g")


def test_updates_equal_a_new_build(spark, tree):
    before = ingest.build(spark, str(tree), tasks=2)
    same = ingest.update(before, spark, str(tree), tasks=2)
    assert same.stats["files_parsed"] == 0 and edges(same.graph) == edges(before.graph) and nodes(same.graph) == nodes(before.graph)
    time.sleep(0.01)
    write(tree, {"pkg/b.py": "def g(x):\n    return h(x)\n\ndef h(x):\n    return x\n", "new/c.py": "from pkg.a import f\ndef n(q):\n    return f(q)\n"})
    os.remove(tree / "tests/test_a.py")
    whole = ingest.build(spark, str(tree), tasks=2)
    for strategy in ("resolve_full", "resolve_local"):
        after = ingest.update(before, spark, str(tree), strategy, tasks=2)
        assert edges(after.graph) == edges(whole.graph) and nodes(after.graph) == nodes(whole.graph)
        assert after.stats["files_parsed"] == 2 and after.stats["files_skipped"] == 6
    diff = {r["rel_path"]: r["op"] for r in changes.dirty_files(before.state, whole.state).collect()}
    assert diff == {"pkg/b.py": "modified", "new/c.py": "added", "tests/test_a.py": "deleted"}
    with pytest.raises(ValueError):
        ingest.update(before, spark, str(tree), "bogus")


def test_touched_file_is_not_parsed_anew(spark, tree):
    before = ingest.build(spark, str(tree), tasks=2)
    os.utime(tree / "pkg/a.py", (1, 1))
    after = ingest.update(before, spark, str(tree), tasks=2)
    assert after.stats["edges_added"] == after.stats["edges_removed"] == 0


def test_store(spark, tree, tmp_path):
    index = ingest.build(spark, str(tree), tasks=2)
    s = store.Store(spark, str(tmp_path / "saved"))
    with pytest.raises(FileNotFoundError):
        s.graph()
    assert s.save_graph(index.graph, parsed=index.parsed) == 1
    back = s.graph()
    assert edges(back) == edges(index.graph) and nodes(Graph_like(back)) == nodes(index.graph)
    assert "embedding" not in s.graph(embeddings=False).nodes.columns
    assert s.get("func::pkg/a.py::f").count() == 1
    new = conform(spark.createDataFrame([("n", "function", "N")], "id string, type string, name string"), NODE)
    add = conform(spark.createDataFrame([("n", "func::pkg/a.py::f", "calls")], "source string, target string, type string"), EDGE)
    gone = index.graph.nodes.where("id = 'file::data.bin'").select("id")
    assert s.save_diff(new, add, gone, index.graph.edges.where("target = 'file::data.bin'").select("source", "target")) == 2
    assert s.tables() == ["edges", "nodes", "parsed"] and s.load("parsed").count() == index.parsed.count()
    ids = {r["id"] for r in s.graph().nodes.collect()}
    assert "n" in ids and "file::data.bin" not in ids and ("n", "func::pkg/a.py::f", "calls") in edges(s.graph())
    s.save_graph(index.graph)
    assert s.versions() == [2, 3]
    s.delete()
    assert s.versions() == []


def Graph_like(g):  # noqa: N802
    from tessera.plans.graph import Graph

    return Graph(conform(g.nodes, NODE), g.edges)


def test_json(spark, tree, tmp_path):
    g = ingest.build(spark, str(tree), tasks=2).graph
    store.write_json(g, str(tmp_path / "j"))
    back = store.read_json(spark, str(tmp_path / "j"))
    assert edges(back) == edges(g) and nodes(back) == nodes(g)
    doc = {"nodes": [{"id": "a", "type": "file", "name": "A", "embedding": [1.0]}], "edges": [{"source": "a", "target": "a", "type": "calls"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    one = store.read_document(spark, str(tmp_path / "d.json"), embeddings=False)
    assert one.nodes.first()["name"] == "A" and "embedding" not in one.nodes.columns and edges(one) == [("a", "a", "calls")]


SOURCES = {
    "a.go": ("type G struct {}\nfunc (g *G) Hi() { Do() }\nfunc main() { x.Y() }\n", {"main"}, {"G": {"Hi"}}),
    "A.java": ("import a.B;\npublic class A extends B implements C {\n  void r() { g(); }\n}\n", set(), {"A": {"r"}}),
    "a.js": ("import x from 'y';\nclass W extends B {\n  go() { m(); }\n}\nfunction i() {}\nconst k = () => { z(); };\n", {"i", "k"}, {"W": {"go"}}),
    "a.cjs": ("const y = require('y');\nfunction q() {}\n", {"q"}, {}),
    "a.ts": ("export class T implements I {\n  a(x: string): void { b(); }\n}\ninterface J { x: 1 }\n", set(), {"T": {"a"}, "J": set()}),
    "a.c": ("#include <x.h>\nstruct S { int a; };\nint f(int a) { return g(a); }\n", {"f"}, {"S": set()}),
    "a.cpp": ("class A : public B {\n  void f() { g(); }\n};\nvoid A::h() {}\nint main() { return 0; }\n", {"main"}, {"A": {"f", "h"}}),
    "a.cs": ("using S;\nclass C : B {\n  public void G() { R(); }\n}\n", set(), {"C": {"G"}}),
    "a.rs": ("use a::b;\nstruct P;\nimpl S for P {\n  fn new() -> P { q() }\n}\nfn main() { P::new(); }\n", {"main"}, {"P": {"new"}}),
    "a.kt": ("import a.b\nclass K : B() {\n  fun f() = g()\n}\nfun t() { K() }\n", {"t"}, {"K": {"f"}}),
    "a.swift": ("import F\nclass A: B {\n  func f() { g() }\n}\nfunc t() {}\n", {"t"}, {"A": {"f"}}),
    "a.php": ("<?php\nuse A\\B;\nclass P extends Q {\n  public function f() { g(); }\n}\nfunction t() {}\n", {"t"}, {"P": {"f"}}),
    "a.rb": ("require 'j'\nclass A < B\n  def x\n    if y\n      z\n    end\n  end\nend\ndef m\n  x\nend\n", {"m"}, {"A": {"x"}}),
    "a.lua": ("local j = require 'j'\nfunction A:b(x)\n  if x then c() end\nend\nlocal function d() end\n", {"d"}, {"A": {"b"}}),
    "a.ex": ("defmodule A.B do\n  import E\n  def f(x) do\n    g(x)\n  end\nend\n", set(), {"A.B": {"f"}}),
    "a.dart": ("import 'b.dart';\nclass A extends B {\n  int f() { return g(); }\n}\nvoid main() {}\n", {"main"}, {"A": {"f"}}),
    "a.scala": ("import a.b\nobject M {\n  def f(x: Int): Int = x\n}\n", set(), {"M": {"f"}}),
    "a.sh": ("source ./l.sh\nX=1\ngo() {\n  run a\n}\n", {"go"}, {}),
    "a.ps1": (". ./l.ps1\nfunction Get-X { Do-It }\n$v = 1\n", {"Get-X"}, {}),
    "a.R": ("library(x)\nf <- function(a) {\n  g(a)\n}\nz <- 1\n", {"f"}, {}),
    "a.sql": ("CREATE TABLE t (id INT);\nCREATE FUNCTION f() RETURNS INT AS SELECT 1 FROM t;\n", {"f"}, {"t": set()}),
    "m.tf": ('resource "a" "b" {\n}\ndata "c" "d" {\n}\nvariable "v" {}\n', {"a.b"}, {"c.d": set()}),
    "Makefile": ("include x.mk\nA = 1\nall: dep\n\techo\ndep:\n\techo\n", {"all", "dep"}, {}),
    "CMakeLists.txt": ("include(X)\nset(A 1)\nadd_executable(app a.c)\ntarget_link_libraries(app PRIVATE l)\n", {"app"}, {}),
    "Dockerfile": ("FROM a AS b\nRUN x\nENV K=1\n", {"run_1"}, {"b": set()}),
    "docker-compose.yml": ("services:\n  web:\n    image: i\n    depends_on:\n      - db\n  db:\n    image: p\n", set(), {"web": {"web"}, "db": set()}),
    "k8s/a.yaml": ("kind: Deployment\nmetadata:\n  name: x\nspec:\n  image: i\n", set(), {"Deployment/x": set()}),
    ".github/workflows/a.yml": ("on: push\njobs:\n  test:\n    uses: a/b@v1\n", {"test"}, {}),
    "build.gradle": ("implementation 'a:b:1'\ntask hi { }\n", {"hi"}, {}),
    "x.rst": ("Title\n=====\n\n.. code-block:: py\n\n   x\n", {"py"}, {"Title": set()}),
    "x.adoc": ("= T\n:a: b\n", set(), {"T": set()}),
    "x.org": ("* H\n#+BEGIN_SRC py\nx\n#+END_SRC\n", {"py"}, {"H": set()}),
    "x.rmd": ("```{r one}\nlibrary(a)\nx <- 1\n```\n", {"one"}, {}),
    "x.ipynb": ('{"cells": [{"cell_type": "code", "source": ["x = 1"]}]}', {"cell_0"}, {}),
    ".editorconfig": ("[*]\nindent = 2\n", set(), {"*": set()}),
}
NAMES = {
    "a.json": ('{"k": 1, "l": {"$ref": "#/d"}}', {"k", "l"}),
    "s.schema.json": ('{"title": "T", "properties": {"p": {}}}', {"T", "p"}),
    "openapi.yaml": ("info:\n  title: API\npaths:\n  /x:\n    get: 1\ncomponents:\n  schemas:\n    S:\n      type: object\n", {"API", "/x", "S"}),
    "a.yaml": ("k: 1\nl: &anc\n  m: 2\n", {"k", "l", "anc"}),
    "a.toml": ("[project]\nname = 'x'\n", {"project"}),
    "a.xml": ('<a><b id="1"/></a>', {"a", "b", "@1"}),
    "pom.xml": ("<project><groupId>g</groupId><artifactId>a</artifactId></project>", {"groupId", "artifactId"}),
    "a.csv": ("x,y\n1,2\n", {"x", "y", "_rows=1"}),
    "a.properties": ("a.b=1\nc: 2\n! no\n", {"a.b", "c"}),
    "x.env": ("export A=1\nB=2\n", {"A", "B"}),
    "x.gitignore": ("*.pyc\n# no\nout/\n", {"*.pyc", "out/"}),
}


@pytest.mark.parametrize("path", SOURCES)
def test_parsers_of_code(path):
    source, functions, classes = SOURCES[path]
    found, name, error = parse(path, source, registry())
    assert error is None and found is not None, (name, error)
    assert {f["name"] for f in found["functions"]} == functions
    assert {c["name"]: {m["name"] for m in c["methods"]} for c in found["classes"]} == classes
    for f in [*found["functions"], *(m for c in found["classes"] for m in c["methods"])]:
        assert {"name", "line_start", "line_end", "source", "calls"} <= set(f) and f["line_start"] <= f["line_end"]
    told = rows(path, found, "0")
    assert all(set(n) <= {f.name for f in NODE} for n in told[0]) and all(set(e) == {f.name for f in EDGE} for e in told[1])


@pytest.mark.parametrize("path", NAMES)
def test_parsers_of_data(path):
    source, names = NAMES[path]
    found, _, error = parse(path, source, registry())
    assert error is None and {v["name"] for v in found["variables"]} == names


def test_registry():
    use = registry()
    names = [p.name for p in use]
    assert len(set(names)) == len(names) == 51  # fifty and plain texts
    at = lambda p: (dispatch(p, use) or use[-1]).name
    assert [at(p) for p in ("a.h", "x.schema.json", "swagger.yml", "pom.xml", "k8s/a.yml", "a.yml", "a.txt")] == ["c1", "jsonschema", "openapi3", "maven1", "k8s_manifest1", "yaml1", "text"]
    off = registry({"python3": {"enabled": False}})
    assert dispatch("a.py", off) is None
    assert parse("a.json", "{bad", use)[0] is None and parse("a.bin", "", use) == (None, None, None)


def test_every_parser_survives_odd_sources():
    for p in registry():
        for source in ("", "\n", "{", "}", "(" * 50, "\x00\ufffd", "a" * 5000, "class function def end {", "'\"`"):
            p.parse(f"x/{p.names[0].replace('*', 'a')}", source)


def test_python_details():
    src = "import re\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from x import Y\n__version__ = '1'\n@d\nclass A(NamedTuple):\n    v: int = 2\n    async def m(self, *a, k=1, **z): pass\ndef out():\n    def inner(): pass\n    with open('f') as f:\n        try: g(1, b)\n        except ValueError: pass\nQ = 'SELECT 1 FROM t'\nre.compile('a+')\nU = 'https://x.y'\n"
    p = parse("m.py", src, registry())[0]
    assert [(f["name"], f["is_nested"]) for f in p["functions"]] == [("out", False), ("inner", True)]
    out = p["functions"][0]
    assert out["context_managers"] == ["open('f')"] and out["exceptions"] == ["ValueError"] and out["complexity"] == 3
    m = p["classes"][0]["methods"][0]
    assert m["is_async"] and [x["kind"] for x in m["params"]] == ["arg", "vararg", "kwonly", "kwarg"]
    assert p["classes"][0]["is_namedtuple"] and p["classes"][0]["class_vars"][0]["value"] == "2"
    assert [i["module"] for i in p["type_checking_imports"]] == ["x"]
    assert {s["kind"] for s in p["strings"]} == {"sql", "regex", "url"}
    assert {v["name"]: v["value"] for v in p["variables"]}["__version__"] == "'1'"


def test_html_details():
    src = "<html><head><title>T</title><meta name='a' content='b'><script src='s.js'></script></head><body><h1>One</h1><p>text</p><h2 id='q'>Two</h2><a href='#q'>go</a><img src='i.png' alt='I'><pre>code</pre><!-- NOTE: see --></body></html>"
    p = parse("x.html", src, registry())[0]
    assert p["title"] == "T" and [s["name"] for s in p["sections"]] == ["One", "Two"] and p["sections"][1]["parent_section"] == "One"
    assert {x["url"]: x["link_type"] for x in p["links"]} == {"#q": "anchor", "i.png": "image"}
    assert {i["module"] for i in p["imports"]} == {"s.js", "i.png"} and p["comments"][0]["tag"] == "NOTE"
    assert "text" in p["documents"][0]["content"] and "<p>" not in p["documents"][0]["content"]


def test_change_stream(spark, tree, tmp_path):
    index = ingest.build(spark, str(tree), tasks=2)
    told = []
    model = lambda number: lambda texts: [[number] for _ in texts]
    w = stream.Watcher(index, spark, str(tree), on_update=told.append, enrich=lambda g, old: enriched(g, old, model=model(2.0 if old else 1.0)))
    changed = events.relevant(stream.file_changes(spark, str(tree), str(tmp_path / "snap")), ["py", "md"])

    def run():
        w.start(changed, str(tmp_path / "check")).awaitTermination()

    run()  # the first look sees all files as new; nothing differs from the index
    assert told == []
    time.sleep(0.01)
    write(tree, {"pkg/b.py": "class Base:\n    pass\n\ndef g(x):\n    return h(x)\n\ndef h(x):\n    return x  # and nothing else, whatever x is\n"})
    os.remove(tree / "tests/test_a.py")
    run()
    assert len(told) == 1 and told[0]["deleted_files"] == ["tests/test_a.py"] and told[0]["changed_files"] == ["pkg/b.py"]
    assert "func::pkg/b.py::h" in told[0]["updated_nodes"] and "file::tests/test_a.py" in told[0]["removed_nodes"]
    assert edges(w.index.graph) == edges(ingest.build(spark, str(tree), tasks=2).graph)
    # What was there keeps its embedding, new sources get one, and all nodes have coordinates.
    got = {r["id"]: r for r in w.graph.nodes.select("id", "embedding", "spatial").collect()}
    assert got["func::pkg/b.py::h"]["embedding"] == [2.0] and got["class::pkg/a.py::A"]["embedding"] == [1.0]
    assert all(r["spatial"] is not None for r in got.values()) and len(got) == w.index.graph.nodes.count()


def test_stream_of_events(spark, sf_dir):
    from tessera.queries import QUERIES

    for a, b in (("stream_dedupe", "dedupe_unchanged"), ("stream_debounce", "debounce_sessions")):
        got, want = QUERIES[a](spark, sf_dir).collect(), QUERIES[b](spark, sf_dir).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_project(tree, tmp_path):
    from tessera.plans.project import Project, Settings, SettingsError

    p = Project.open(str(tree))
    assert Project.open(str(tree)).project_id == p.project_id and not p.indexed
    assert p.set_filters(exclude_dirs=("docs",)).exclude_dirs == ("docs",)
    assert Project.open(str(tree)).as_filters().exclude_dirs == ("docs",)
    for bad in ({"mode": "x"}, {"what": 1}):
        with pytest.raises(SettingsError):
            p.set_filters(**bad)
    s = Settings(str(tmp_path / "settings.json"))
    assert [r["root"] for r in s.opened(p)] == [p.root] and len(s.opened(p)) == 1
    base = {"enabled": True, "tags": ["TODO"], "size": 1, "_size": "a note", "name": "x"}
    assert s.set_parser("python3", {"tags": [], "size": 2.5}, base) == {"enabled": True, "tags": [], "size": 2.5, "name": "x"}
    for bad in ({"enabled": 1}, {"size": True}, {"name": 1}, {"zzz": 1}, {"_size": "x"}):
        with pytest.raises(SettingsError):
            s.set_parser("python3", bad, base)
    assert Settings(str(tmp_path / "settings.json")).parser("python3", {"tags": ["A"]}) == {"tags": []}
    assert files.browse(str(tree)) == ["build", "docs", "node_modules", "pkg", "tests", "venv1"]


def test_command_line(spark, tree, capsys):
    from tessera.__main__ import main

    main(["--root", str(tree), "index"])
    main(["--root", str(tree), "index", "--incremental", "--no-spatial", "--no-embeddings"])
    capsys.readouterr()
    for command, part in (
        (["status"], "function"), (["query", "f", "-t", "function", "--callers"], "method::pkg/a.py::A::m"), (["search", "broken"], "["),
        (["inspect", "func::pkg/a.py::f"], "func::pkg/b.py::g"), (["spatial", "--face", "1"], ""), (["spatial-walk", "func::pkg/a.py::f"], ""),
    ):
        main(["--root", str(tree), *command])
        assert part in capsys.readouterr().out
