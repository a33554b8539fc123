"""Lookups, traversals, ranks and coordinates on small graphs, against plain definitions."""

from __future__ import annotations

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import find, rank, spatial, traverse, vector
from tessera.plans.graph import Graph, unique_edges, unique_nodes

NODES = [
    ("a", "function", "Alpha", "src/a.py", 1, (10.0, 10.0, 0.5, 1)),
    ("b", "function", "beta", "src/a.py", 9, (20.0, 12.0, 0.1, 2)),
    ("c", "class", "alphabet", "tests/c.py", 3, (40.0, 10.0, 0.9, 1)),
    ("d", "method", "_hidden", "src/d.py", None, (10.0, 40.0, 0.3, -2)),
    ("e", "variable", None, "config/e.py", None, None),
    ("f", None, "a%b", None, None, None),
]
EDGES = [
    ("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("b", "b", "calls"), ("a", "d", "defines"),
    ("d", "e", "defines"), ("e", "a", "imports"), ("c", "d", "contains"),
]


@pytest.fixture(scope="module")
def graph(spark):
    kind = "id string, type string, name string, path string, line_start int, spatial struct<x:double,y:double,z:double,face:int>"
    return Graph(spark.createDataFrame(NODES, kind), spark.createDataFrame(EDGES, "source string, target string, type string"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_find(graph):
    assert ids(find.find(graph.nodes, "ALPHA")) == ["a", "c"]
    assert ids(find.find(graph.nodes, "alpha", "class")) == ["c"]
    assert ids(find.find(graph.nodes, "%")) == ["f"]
    assert ids(find.find(graph.nodes, "")) == ["a", "b", "c", "d", "e", "f"]
    assert ids(find.under(graph.nodes, "src/")) == ["a", "b", "d"]


def test_details(graph):
    got = sorted((r["direction"], r["other"], r["type"], r["same_file"]) for r in find.edge_details(graph, "a").collect())
    assert got == [("in", "c", "calls", False), ("in", "e", "imports", False), ("out", "b", "calls", True), ("out", "d", "defines", False)]
    assert ids(find.defined_in(graph, "d")) == ["a"] and ids(find.defined_in(graph, "a")) == []
    assert ids(find.children(graph, "a")) == ["d"] and ids(find.children(graph, "c", "method")) == ["d"]


def test_connections(graph, spark):
    lines = spark.createDataFrame([("src/a.py", n, f"line {n}") for n in range(1, 12)], "path string, n int, text string")
    got = {r["other"]: r for r in find.connections(graph, "a", lines).collect()}
    assert [x["n"] for x in got["b"]["snippet"]] == [8, 9, 10] and got["b"]["error"] is None
    assert got["d"]["error"] == "no line" and got["c"]["error"] == "no source"


def test_stats(graph):
    got = {(r["kind"], r["type"]): r["n"] for r in find.stats(graph).collect()}
    assert got["node", "function"] == 2 and got["node", "unknown"] == 1 and got["node", None] == 6
    assert got["edge", "calls"] == 4 and got["edge", None] == 8


def test_lineage(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string")
    assert sorted(map(tuple, find.lineage(df).collect())) == [("a", "", "a"), ("a/b", "a", "b")]


def brute_bfs(start, depth, kinds, direction):
    """Each node once, at its least depth; the start isn't visited in advance."""
    seen, out, queue = set(), {}, deque([(start, 0)])
    if start not in {n[0] for n in NODES}:
        return {}
    while queue:
        now, d = queue.popleft()
        if d > 0 and now not in seen:
            seen.add(now)
            out[now] = d
        if d < depth:
            for a, b, kind in EDGES:
                if not kinds or kind in kinds:
                    if direction in ("in", "both") and b == now and a not in seen:
                        queue.append((a, d + 1))
                    if direction in ("out", "both") and a == now and b not in seen:
                        queue.append((b, d + 1))
    return out


@pytest.mark.parametrize("depth", [1, 3])
@pytest.mark.parametrize("kinds", [None, ["calls", "defines"]])
@pytest.mark.parametrize("direction", ["in", "out", "both"])
def test_neighbors(graph, depth, kinds, direction):
    got = {r["id"]: r["depth"] for r in traverse.neighbors(graph, "a", depth, kinds, direction).collect()}
    assert got == brute_bfs("a", depth, kinds, direction)


def test_traversal_edges(graph, spark):
    assert traverse.callers(graph, "nobody", 3).count() == 0
    assert ids(traverse.callees(graph, "a", 3)) == ["a", "b", "c"]  # back by a cycle
    found = traverse.from_each(graph, spark.createDataFrame([("a",), ("b",)], "id string"), depth=3).collect()
    assert sorted((r["origin"], r["id"]) for r in found) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]


def test_affected(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "file string, dependent string")
    dirty = spark.createDataFrame([("a",), ("x",)], "rel_path string")
    got = {h: {r["rel_path"]: r["hop"] for r in traverse.affected(deps, dirty, h).collect()} for h in (1, 2)}
    assert got[1] == {"a": 0, "x": 0, "b": 1} and got[2] == {"a": 0, "x": 0, "b": 1, "c": 2}


def test_entry_depth(spark):
    nodes = spark.createDataFrame([(x,) for x in "pqrstu"], "id string")
    edges = [("p", "q", "calls"), ("q", "r", "defines"), ("q", "s", "contains"), ("t", "u", "calls"), ("u", "t", "calls")]
    got = {r["id"]: r["y"] for r in traverse.entry_depth(Graph(nodes, spark.createDataFrame(edges, "source string, target string, type string"))).collect()}
    assert got == {"p": 0.0, "q": 360.0, "r": 0.0, "s": 0.0, "t": 180.0, "u": 180.0}
    flat = traverse.entry_depth(Graph(nodes, spark.createDataFrame([], "source string, target string, type string")))
    assert {r["y"] for r in flat.collect()} == {0.0}


def test_degree_and_cloud(graph):
    assert {r["id"]: r["degree"] for r in rank.degree(graph).collect()} == {"a": 4, "b": 4, "c": 3, "d": 3, "e": 2, "f": 0}
    rows = rank.word_cloud(graph).collect()
    assert [(r["name"], r["value"]) for r in rows] == [("Alpha", 4.0), ("beta", 4.0), ("_hidden", 3.0), ("alphabet", 3.0)]
    assert {r["total"] for r in rows} == {5}
    assert [r["name"] for r in rank.word_cloud(graph, "all").collect()][-1] == "a%b"
    assert rank.word_cloud(graph, "bogus").count() == 4 and rank.word_cloud(graph, path="tests/").count() == 1


def test_capped(graph):
    nodes, edges, told = rank.capped(graph, limit=3, max_edges=2)
    assert [r["id"] for r in nodes.orderBy(F.desc("degree"), "id").collect()] == ["a", "b", "c"]
    assert told == {"total_nodes": 6, "total_edges": 4, "truncated": True, "edges_truncated": True}
    assert sorted((r["source"], r["target"]) for r in edges.collect()) == [("a", "b"), ("b", "b")]
    sizes = {r["id"]: r["symbol_size"] for r in nodes.collect()}
    assert sizes == {"a": 50, "b": 50, "c": 40}


def test_pagerank(spark):
    rng = random.Random(2)
    n = 30
    edges = sorted({(str(rng.randrange(n - 3)), str(rng.randrange(n))) for _ in range(90)})
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    ranks = {str(k): 1 / n for k in range(n)}
    for _ in range(100):
        lost = sum(r for k, r in ranks.items() if k not in out)
        new = {k: 0.15 / n + 0.85 * lost / n for k in ranks}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * ranks[a] / len(bs)
        change = sum(abs(new[k] - ranks[k]) for k in ranks)
        ranks = new
        if change < n * 1e-4:
            break
    g = Graph(
        spark.createDataFrame([(str(k),) for k in range(n)], "id string"),
        spark.createDataFrame([(a, b, "calls") for a, b in edges], "source string, target string, type string"),
    )
    got = {r["id"]: r["rank"] for r in rank.pagerank(g, tol=1e-4).collect()}
    assert all(math.isclose(got[k], ranks[k], rel_tol=1e-9) for k in ranks) and math.isclose(sum(got.values()), 1)
    z = [r["z"] for r in rank.importance(g, tol=1e-4).collect()]
    assert min(z) == 0 and max(z) == 1
    assert rank.pagerank(Graph(g.nodes.limit(0), g.edges.limit(0))).count() == 0


def test_faces(graph):
    got = {r["id"]: r["face"] for r in rank.faces(graph).collect()}
    assert got == {"a": 2, "b": 2, "c": 6, "d": -1, "e": 5, "f": 1}


def test_projection(spark):
    rows = [(str(k), [float(k), 2.0 * k, 0.0]) for k in range(5)] + [("n", None), ("bad", [float("nan"), 4.0, float("inf")])]
    got = {r["id"]: r["x"] for r in rank.projection(spark.createDataFrame(rows, "id string, embedding array<float>")).collect()}
    assert "n" not in got and got["0"] == 0.0 and math.isclose(got["4"], 360.0)
    same = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 1.0])], "id string, embedding array<float>")
    assert {r["x"] for r in rank.projection(same).collect()} == {180.0}


def test_coordinates(graph):
    told = rank.coordinates(
        graph, graph.nodes.select("id", F.lit(None).cast("array<float>").alias("embedding")), tol=1e-3
    ).collect()
    assert len(told) == 6 and {r["spatial"]["x"] for r in told} == {180.0}


def test_range(graph):
    n = graph.nodes
    assert [r["id"] for r in spatial.in_range(n, 10, 10, 10).collect()] == ["a", "b"]
    assert [r["id"] for r in spatial.in_range(n, 10, 10, 30, top=2).collect()] == ["a", "b"]
    assert [r["id"] for r in spatial.in_range(n, 10, 10, 30, z_min=0.4, top=0).collect()] == ["a", "c"]
    assert [r["id"] for r in spatial.in_range(n, 10, 10, 50, face=2).collect()] == ["b"]
    assert [r["id"] for r in spatial.on_face(n, 1).collect()] == ["c", "a"] and spatial.on_face(n, 9).count() == 0
    assert [r["id"] for r in spatial.near(n, "a", 30, 1).collect()] == ["b"]
    assert spatial.near(n, "e").count() == 0 and spatial.near(n, "nobody").count() == 0


def test_walk(graph):
    for step in (10.0, 15.0, 30.0):
        got = {r["id"]: r["ring"] for r in spatial.walk(graph.nodes, "a", step, 3).collect()}
        want, seen = {"a": 0}, {"a"}
        for ring in range(1, 4):
            for r in spatial.in_range(graph.nodes, 10, 10, ring * step, top=0).collect():
                if r["id"] not in seen:
                    seen.add(r["id"])
                    want[r["id"]] = ring
        assert got == want


def test_range_with_neighbors(graph):
    got = spatial.with_neighbors(graph, 10, 10, 5, depth=2).collect()
    assert sorted((r["origin"], r["id"]) for r in got) == [("a", "b"), ("a", "c")]
    got = spatial.with_neighbors(graph, 10, 10, 5, direction="in", edge_type="imports").collect()
    assert got == []  # e has no coordinates


def test_vectors(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "y", [1.0, 1.0]), ("z", "x", [0.0, 0.0]), ("n", "x", None)]
    df = spark.createDataFrame(rows, "id string, type string, embedding array<float>")
    got = [(r["id"], round(r["score"], 6)) for r in vector.top(df, [1.0, 0.0]).collect()]
    assert got == [("a", 1.0), ("b", 0.707107), ("z", 0.0)]
    assert [r["id"] for r in vector.top(df, [1.0, 0.0], drop_zero=True).collect()] == ["a", "b"]
    assert vector.top(df, [0.0, 0.0], drop_zero=True).count() == 0
    assert [r["id"] for r in vector.top(df, [1.0, 0.0], 1, "y").collect()] == ["b"]


def test_inverted_file(spark, sf_dir, tmp_path):
    from tessera.sources.tables import star_vectors

    df = star_vectors(spark, sf_dir)
    index = vector.InvertedFile(df)
    found = []
    for r in df.orderBy("id").limit(8).collect():
        q = list(r["embedding"])
        found.append(vector.recall(index.search(q, 10, max(8, index.k // 2)), vector.top(df, q, 10)))
    assert sum(found) / len(found) >= 0.9
    index.write(str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    assert ids(index.search(q, 10, 8, again)) == ids(index.search(q, 10, 8))


def test_multi(graph):
    got = [(r["id"], list(r["matched"])) for r in vector.multi_find(graph.nodes, ["alpha", "b", ""]).collect()]
    assert got == [("c", ["alpha", "b"]), ("a", ["alpha"]), ("b", ["b"]), ("f", ["b"])]


def test_embedding(spark):
    rows = [("a", "function", "x " * 30), ("b", "function", "short"), ("c", "import", "x " * 30), ("d", "class", None)]
    got = vector.embed_nodes(spark.createDataFrame(rows, "id string, type string, source string")).collect()
    assert {r["id"] for r in got if r["embedding"] is not None} == {"a"}
    found = vector.search(spark.createDataFrame(got, "id string, type string, source string, embedding array<float>").withColumn("name", F.lit("n")), "x", vector.hashed_embedding)
    assert [r["id"] for r in found.collect()] == ["a"]


def test_unique(spark):
    rows = [("a", "b", "tests", 1), ("a", "b", "calls", 2), ("a", "b", "calls", 3), ("b", "a", "defines", 1)]
    got = unique_edges(spark.createDataFrame(rows, "source string, target string, type string, call_line int"), "call_line").collect()
    assert sorted(map(tuple, got)) == [("a", "b", "calls", 3), ("b", "a", "defines", 1)]
    nodes = spark.createDataFrame([("a", 1, "x", "k"), ("a", 2, None, "l")], "id string, seq int, p string, q string")
    assert [tuple(r) for r in unique_nodes(nodes, "seq").collect()] == [("a", "x", "l")]
