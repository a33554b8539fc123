"""From a file tree to a graph, whole or by its changes."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import directory
from tessera.operators import changes, find, resolve
from tessera.operators.traverse import affected
from tessera.plans.graph import Graph, unique_edges
from tessera.plans.scratch import cut
from tessera.schema import EDGE, NODE, conform
from tessera.sources import files
from tessera.sources.parsers import registry
from tessera.sources.parsers.base import Parser


@dataclass(frozen=True)
class Index:
    """A graph with the table of parsed files that it was made of, which is all that an update needs."""

    graph: Graph
    parsed: DataFrame
    stats: dict

    @property
    def state(self) -> DataFrame:
        return self.parsed.select("rel_path", "sha256", "mtime_ns", "size")


def _flat(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select(F.inline(column))


def directories(parsed: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the folders above the files and of the root, and the edges that contain."""
    spark = parsed.sparkSession
    paths = parsed.select(F.col("rel_path").alias("path"))
    dirs = find.lineage(paths)
    dir_id = lambda p: F.when(p == "", "dir::.").otherwise(F.concat(F.lit("dir::"), p))
    top = spark.range(1).select(F.lit("dir::.").alias("id"), F.lit("directory").alias("type"), F.lit(root.rstrip("/").rsplit("/", 1)[-1]).alias("name"), F.lit("").alias("path"), F.lit(root).alias("abs_path"))
    rest = dirs.select(dir_id(F.col("path")).alias("id"), F.lit("directory").alias("type"), "name", "path", F.lit(None).cast("string").alias("abs_path"))
    in_dirs = dirs.select(dir_id(F.col("parent")).alias("source"), dir_id(F.col("path")).alias("target"))
    in_files = paths.select(dir_id(directory(F.col("path"))).alias("source"), F.concat(F.lit("file::"), "path").alias("target"))
    return top.unionByName(rest), in_dirs.unionByName(in_files).withColumn("type", F.lit("contains"))


def own_edges(parsed: DataFrame, nodes: DataFrame, symbols: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Edges out of the files' own lists and out of names. calls: those to use instead of resolving all."""
    found = resolve.calls(_flat(parsed, "calls"), _flat(parsed, "imports"), symbols) if calls is None else calls
    parts = [_flat(parsed, "edges"), resolve.inherits(nodes, symbols), resolve.tests(nodes, symbols), found]
    out = conform(parts[0], EDGE)
    for p in parts[1:]:
        out = out.unionByName(conform(p, EDGE))
    return out


def assemble(parsed: DataFrame, root: str, calls: DataFrame | None = None) -> Graph:
    """The graph of a table of parsed files: set-based joins, with one symbol table of all files."""
    own = conform(_flat(parsed, "nodes"), NODE)
    dirs, contains = directories(parsed, root)
    symbols = cut(resolve.symbols(own))
    edges = unique_edges(own_edges(parsed, own, symbols, calls).unionByName(conform(contains, EDGE)))
    return Graph(conform(dirs, NODE).unionByName(own), edges)


def _parse(spark: SparkSession, found: DataFrame, root: str, parsers: list[Parser], tasks: int) -> DataFrame:
    return files.parse(found.repartition(tasks, "rel_path"), root, parsers)


def build(
    spark: SparkSession, root: str, parsers: list[Parser] | None = None, filters: files.Filters | None = None, tasks: int = 32
) -> Index:
    began = time.time()
    use = registry() if parsers is None else parsers
    found = files.kept(files.listing(spark, root), use, filters)
    parsed = cut(_parse(spark, found, root, use, tasks))
    graph = assemble(parsed, root)
    graph = Graph(cut(graph.nodes), cut(graph.edges))
    return Index(graph, parsed, _stats("full", began, parsed, parsed.limit(0), graph, None, 0))


def update(
    before: Index,
    spark: SparkSession,
    root: str,
    strategy: str = "resolve_full",
    parsers: list[Parser] | None = None,
    filters: files.Filters | None = None,
    hops: int = 1,
    tasks: int = 32,
) -> Index:
    """The index after files changed. Only files with another stamp are read, and only those with another hash are parsed
    anew; deleted files leave with all that was in them.

    full: everything anew. resolve_full: all names are resolved again, over the merged table. resolve_local: calls only
    of the changed files and of those that depend on them, or that call a name which was added or taken away; the other
    files' calls are kept. All three give the same graph.
    """
    if strategy == "full":
        return build(spark, root, parsers, filters, tasks)
    if strategy not in ("resolve_full", "resolve_local"):
        raise ValueError(f"unknown strategy {strategy}")
    began = time.time()
    use = registry() if parsers is None else parsers
    found = cut(files.kept(files.listing(spark, root), use, filters))
    read = changes.to_read(before.state, found)
    fresh = cut(_parse(spark, read, root, use, tasks))
    gone = before.state.select("rel_path").join(found.select("rel_path"), "rel_path", "left_anti")
    out = gone.union(fresh.select("rel_path"))
    parsed = cut(before.parsed.join(out, "rel_path", "left_anti").unionByName(fresh))
    dirty = cut(changes.dirty_files(before.state, parsed.select("rel_path", "sha256")))
    calls, touched = None, 0
    if strategy == "resolve_local":
        calls, touched = _local_calls(before, parsed, dirty, hops)
    graph = assemble(parsed, root, calls)
    graph = Graph(cut(graph.nodes), cut(graph.edges))
    return Index(graph, parsed, _stats(strategy, began, parsed, fresh, graph, before.graph, touched))


def _local_calls(before: Index, parsed: DataFrame, dirty: DataFrame, hops: int) -> tuple[DataFrame, int]:
    old_names = resolve.symbols(conform(_flat(before.parsed, "nodes"), NODE))
    new_names = cut(resolve.symbols(conform(_flat(parsed, "nodes"), NODE)))
    changed = (
        old_names.withColumnRenamed("target", "_old")
        .join(new_names.withColumnRenamed("target", "_new"), "name", "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(F.element_at(F.split("name", r"\."), -1).alias("_last"))
        .distinct()
    )
    # Whatever a call expands to, its last part is that of the name which it means.
    by_name = (
        _flat(parsed, "calls").withColumn("_last", F.element_at(F.split("name", r"\."), -1)).join(changed, "_last", "left_semi")
    )
    near = affected(changes.dependencies(before.graph), dirty.select("rel_path"), hops).select("rel_path")
    redo = cut(near.union(by_name.select(F.col("path").alias("rel_path"))).distinct())
    some = parsed.join(redo, "rel_path", "left_semi")
    fresh = resolve.calls(_flat(some, "calls"), _flat(some, "imports"), new_names)
    owner = _flat(before.parsed, "nodes").select(F.col("id").alias("source"), F.col("path").alias("rel_path"))
    kept = before.graph.edges.where("type = 'calls'").join(owner, "source").join(redo, "rel_path", "left_anti")
    return conform(kept, EDGE).unionByName(conform(fresh, EDGE)), redo.count()


def _stats(strategy: str, began: float, parsed: DataFrame, fresh: DataFrame, graph: Graph, old: Graph | None, touched: int) -> dict:
    total = parsed.count()
    read = total if strategy == "full" else fresh.count()
    diff = {r["op"]: r["count"] for r in changes.edge_diff(old.edges, graph.edges).groupBy("op").count().collect()} if old else {}
    return {
        "strategy": strategy,
        "duration_ms": (time.time() - began) * 1000,
        "files_total": total,
        "files_parsed": read,
        "files_skipped": total - read,
        "files_affected": touched or read,
        "edges_resolved": graph.edges.where(F.col("type").isin("calls", "inherits", "tests")).count(),
        "edges_added": diff.get("added", graph.edges.count() if old is None else 0),
        "edges_removed": diff.get("removed", 0),
        "nodes": graph.nodes.count(),
    }
