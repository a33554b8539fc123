"""Texts, changes, names, annotations and chats."""

from __future__ import annotations

import fnmatch
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.encode import tabular
from tessera.operators import changes, notes, resolve, text
from tessera.plans.graph import Graph
from tessera.schema import ANNOTATION, THREAD

TEXT = "one\ntwo TODO\r\nthree\n\n# todo: fix\nfour two\n"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("a.py", TEXT), ("b/c.txt", "two"), ("d.py", ""), ("e.py", "x\n" * 300)]
    return spark.createDataFrame(rows, "path string, content string")


def test_lines(texts):
    got = text.lines(texts).where("path = 'a.py'").orderBy("n").collect()
    assert [r["text"] for r in got] == ["one", "two TODO", "three", "", "# todo: fix", "four two"]
    assert text.lines(texts).where("path = 'd.py'").count() == 0


def test_grep(texts):
    got = sorted(text.grep(texts, "tw[o]", context=2).collect())
    assert [(r["path"], r["line_no"], r["context_before"], r["context_after"]) for r in got] == [
        ("a.py", 2, ["one"], ["three", ""]),
        ("a.py", 6, ["", "# todo: fix"], []),
        ("b/c.txt", 1, [], []),
    ]
    assert text.grep(texts, "^x$", context=0).count() == 200
    assert text.grep(texts, "tw[o]", regex=False).count() == 0
    assert text.grep(texts, r"(?P<n>t)wo", context=0).count() == 3
    with pytest.raises(text.PatternError):
        text.grep(texts, "(")


def test_project_grep(texts):
    assert [(r["path"], r["line_no"]) for r in text.project_grep(texts, "two").collect()] == [("a.py", 2), ("a.py", 6)]
    assert text.project_grep(texts, "two", "*.txt, *.py").count() == 3
    assert text.project_grep(texts, "x", context=0).count() == 301  # "fix" too


def test_section_and_stats(texts):
    assert [r["n"] for r in text.section(texts, "a.py", 2, 3).collect()] == [2, 3]
    assert text.section(texts, "e.py", 1, 10_000).count() == 300
    got = {r["path"]: r for r in text.file_stats(texts).collect()}
    assert got["a.py"]["lines"] == 6 and got["d.py"]["lines"] == 0 and got["b/c.txt"]["lines"] == 1
    assert got["a.py"]["language"] == "python" and got["b/c.txt"]["language"] == "text"
    assert text.unchanged(texts, "d.py", "d41d8cd98f00b204e9800998ecf8427e").first()["same"]
    assert not text.content(texts, "a.py").first()["truncated"]
    tags = [(r["n"], r["tag"], r["text"]) for r in text.comment_tags(texts).collect()]
    assert tags == [(5, "TODO", "fix")]


def test_sections(spark):
    md = "# A\ntext\n## B\n```\n# no\n```\n### C\n## D\n# E #\n"
    df = spark.createDataFrame([("x.md", md)], "path string, content string")
    totals = text.lines(df).groupBy("path").agg(F.count("*").alias("lines"))
    got = text.spans(text.headings(df), totals).orderBy("line_start").collect()
    assert [(r["name"], r["level"], r["line_start"], r["line_end"], r["parent_section"]) for r in got] == [
        ("A", 1, 1, 2, None), ("B", 2, 3, 6, "A"), ("C", 3, 7, 7, "B"), ("D", 2, 8, 8, "A"), ("E", 1, 9, 9, None),
    ]


@given(st.text("ab*?[]!.c", max_size=6), st.lists(st.text("abc.!", max_size=5), max_size=5))
def test_globs(glob, names):
    if "[]" in glob or "[!]" in glob or re.search(r"\[[^\]]*[\[]", glob):
        return  # shells differ here
    for n in names:
        assert bool(re.match(paths.glob_regex(glob), n)) == fnmatch.fnmatchcase(n, glob)


def test_path_functions(spark):
    df = spark.createDataFrame([("pkg/mod/__init__.py",), ("a.PY",), ("x/Dockerfile",), ("n",)], "p string")
    p = F.col("p")
    got = df.select(paths.module(p), paths.suffix(p), paths.language(p), paths.directory(p), paths.base_name(p)).collect()
    assert [tuple(r) for r in got] == [
        ("pkg.mod", "py", "python", "pkg/mod", "__init__.py"), ("a.PY", "py", "python", "", "a.PY"),
        ("x.Dockerfile", "", "dockerfile", "x", "Dockerfile"), ("n", "", "", "", "n"),
    ]
    links = spark.createDataFrame([("https://a",), ("//b",), ("#c",), ("d/e.md",), ("mailto:x",)], "u string")
    assert [r[0] for r in links.select(paths.link_kind(F.col("u"))).collect()] == ["external", "external", "anchor", "internal", "external"]
    assert spark.range(1).select(paths.slug(F.lit(" Héllo, World!  x_1 "))).first()[0] == "héllo-world-x_1"


def test_tabular():
    rows = [{"id": f"n{k}", "name": f'a,"{k}', "n": k, "x": None} for k in range(9)]
    made = tabular(rows)
    assert made.startswith("[9]{id,name,n,x}:\n") and made.count("\n") == 9
    assert tabular([]) == "[]" and tabular([{"a": 1}, {"b": 2}]).startswith("[{")


def test_diffs(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "id string, p int, q string")
    new = spark.createDataFrame([("b", 2, "x"), ("c", 4, "y"), ("d", 1, None)], "id string, p int, q string")
    got = {r["id"]: r["op"] for r in changes.node_diff(old, new).collect()}
    assert got == {"a": "removed", "c": "modified", "d": "added"}
    e = "source string, target string, type string"
    a = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "calls")], e)
    b = spark.createDataFrame([("a", "b", "tests"), ("a", "c", "calls")], e)
    assert sorted(tuple(r) for r in changes.edge_diff(a, b).collect()) == [("a", "b", "calls", "removed"), ("a", "b", "tests", "added")]
    assert changes.edge_diff(a, a).count() == 0


def test_dependencies(spark):
    rows = [("func::a.py::f", "func::b.py::g", "calls"), ("file::c.py", "func::b.py::g", "imports"), ("func::a.py::f", "func::a.py::h", "calls"), ("file::a.py", "func::z.py::f", "defines")]
    g = Graph(spark.range(0), spark.createDataFrame(rows, "source string, target string, type string"))
    assert sorted(map(tuple, changes.dependencies(g).collect())) == [("b.py", "a.py"), ("b.py", "c.py")]


def test_runs(spark):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(hours=k), "resolve_local" if k else "full", 10.0 + k, 3, 2, 1) for k in range(5)]
    runs = spark.createDataFrame(rows, "started_at timestamp, strategy string, duration_ms double, files_total long, edges_added long, edges_removed long")
    assert tuple(changes.run_summary(runs).first()) == (5, 12.0, 15, 10, 5, "full,resolve_local")
    assert changes.force_full(runs, 4).first()["force"] and not changes.force_full(runs, 5).first()["force"]
    assert tuple(changes.run_summary(runs.limit(0)).first())[:2] == (0, 0.0)
    assert changes.strategy("auto", True) == "resolve_local" and changes.strategy("auto", False) == "resolve_full" and changes.strategy("full", True) == "full"


def test_calls(spark):
    nodes = spark.createDataFrame(
        [("func::m/a.py::f", "function", "f", "m/a.py", 1, None), ("func::b.py::g", "function", "g", "b.py", 2, None), ("class::b.py::C", "class", "C", "b.py", 5, None), ("method::b.py::C::run", "method", "run", "b.py", 6, "C"), ("func::z.py::f", "function", "f", "z.py", 1, None)],
        "id string, type string, name string, path string, line_start int, parent_class string",
    ).withColumn("line", F.lit(None).cast("int"))
    table = resolve.symbols(nodes)
    names = {r["name"]: r["target"] for r in table.collect()}
    assert names["f"] == "func::z.py::f" and names["m.a.f"] == "func::m/a.py::f" and names["C.run"] == names["b.C.run"]
    imports = spark.createDataFrame([("b.py", "m.a", [], "q", 1), ("b.py", "m.a", ["f"], None, 2)], "path string, module string, names array<string>, alias string, line int")
    calls = [("q.f", 1), ("x.y.g", 2), ("g", 3), ("nothing", 4), ("self.run.f", 5), ("C.run", 6)]
    called = spark.createDataFrame([("func::b.py::g", "b.py", n, ["1"], k) for n, k in calls], "caller string, path string, name string, args array<string>, line int")
    got = {r["call_line"]: r["target"] for r in resolve.calls(called, imports, table).collect()}
    assert got == {1: "func::m/a.py::f", 5: "func::z.py::f", 6: "method::b.py::C::run"}


def _note(k, **more):
    base = {"id": k, "type": "note", "target": {"type": "file", "file_path": f"{k}.py", "node_id": None}, "content": "", "tags": ["t"], "color": "red", "highlight_range": None, "stale": False, "created_at": datetime(2024, 1, 1), "last_modified_at": datetime(2024, 1, 1)}
    return base | more


def test_annotations(spark):
    empty = spark.createDataFrame([], ANNOTATION)
    own = notes.add(empty, [_note("a"), _note("b", type="tag", tags=["u"], target={"type": "node", "file_path": None, "node_id": "n1"}), _note("c", target={"type": "node", "file_path": None, "node_id": "n2"})])
    assert [r["id"] for r in notes.by_tag(own, "u").collect()] == ["b"] and notes.by_type(own, "note").count() == 2
    assert [r["id"] for r in notes.by_target(own, node_id="n1").collect()] == ["b"]
    assert notes.delete(own, "a").count() == 2 and [r["id"] for r in notes.latest(own, 2).collect()] == ["a", "b"]
    changed = notes.update(own, "a", {"content": "new", "tags": ["x", "y"]}, datetime(2025, 1, 1)).where("id = 'a'").first()
    assert changed["content"] == "new" and changed["tags"] == ["x", "y"] and changed["last_modified_at"].year == 2025
    for bad in ({"type": "x"}, {"color": "beige"}, {"target": {"type": "file"}}, {"target": None}):
        with pytest.raises(notes.AnnotationError):
            notes.check(_note("z", **bad))
    moves = spark.createDataFrame([("a.py", "z.py")], "old string, new string")
    remap = spark.createDataFrame([("n1", None), ("n2", "n3")], "old string, new string")
    out, counts = notes.retarget(own, moves, remap)
    got = {r["id"]: r for r in out.collect()}
    assert got["a"]["target"]["file_path"] == "z.py" and got["b"]["stale"] and got["c"]["target"]["node_id"] == "n3"
    assert tuple(counts.first()) == (2, 1)
    out, new = notes.validate_files(own, spark.createDataFrame([("q.py",)], "path string"))
    assert {r["id"]: r["stale"] for r in out.collect()} == {"a": True, "b": False, "c": False} and new.first()[0] == 1
    sets = spark.createDataFrame([("k", ["a", "b"])], "id string, annotation_ids array<string>")
    assert notes.without_member(sets, "a").first()["annotation_ids"] == ["b"]


def test_threads(spark):
    t = datetime(2024, 1, 1)
    threads = spark.createDataFrame([("x", "New Chat", "p", t, t, []), ("y", "Named", None, t, t - timedelta(days=40), [("user", "q", t)])], THREAD)
    told = notes.append_message(threads, "x", "user", "w" * 70, t + timedelta(hours=1))
    told = notes.append_message(told, "x", "assistant", "first", t + timedelta(hours=2))
    told = notes.replace_last(told, "x", "second", t + timedelta(hours=3))
    got = told.where("id = 'x'").first()
    assert got["title"] == "w" * 60 + "..." and [m["content"][:6] for m in got["messages"]] == ["wwwwww", "second"]
    assert [r["messages"] for r in notes.thread_list(told).collect()] == [2, 1]
    assert notes.in_project(told, "p").count() == 1 and notes.in_project(told, "p", listing=False).count() == 2
    assert [r["id"] for r in notes.prune_threads(threads, t, 30).collect()] == ["x"]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "Hello"), (2, 0, "assistant", "hello x")], "conv_id long, turn long, role string, text string")
    assert sorted((r["conv_id"], r["messages"], r["title"]) for r in notes.thread_summary(turns).collect()) == [(1, 2, "Hello"), (2, 1, "New Chat")]
    assert [r["conv_id"] for r in notes.search_sessions(turns, "HELLO").collect()] == [2, 1]
    assert notes.keep_last(turns, 1).count() == 2
    tagged = threads.withColumn("tags", F.when(F.col("id") == "x", F.array(F.lit("Plan"))))
    find = lambda df, text, **more: [r["id"] for r in notes.search_threads(df, text, **more).collect()]
    assert find(tagged, "plan") == ["x"] and find(tagged, "NAMED") == ["y"] and find(threads, "Q") == ["y"]
    assert find(threads, "n") == ["x", "y"] and find(threads, "n", newest=1) == ["x"] and find(threads.limit(0), "n") == []


def test_history(spark):
    from tessera.schema import REINDEX_RUN

    t, runs = datetime(2024, 1, 1), spark.createDataFrame([], REINDEX_RUN)
    assert changes.next_strategy(runs) == "resolve_local"
    for k in range(4):
        runs = changes.recorded(runs, {"started_at": t + timedelta(hours=k), "strategy": "resolve_full", "files_total": k}, 3)
    assert [r["files_total"] for r in changes.last_runs(runs).collect()] == [3, 2, 1]
    assert changes.next_strategy(runs, after=3) == "full" and changes.next_strategy(runs, foreground=False, after=4) == "resolve_full"
