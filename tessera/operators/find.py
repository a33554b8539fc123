"""Lookups on nodes and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph


def find(nodes: DataFrame, name: str, node_type: str | None = None) -> DataFrame:
    """Nodes whose name holds the given text in any case; wildcards have no meaning."""
    out = nodes.where(F.lower(F.coalesce("name", F.lit(""))).contains(name.lower()))
    return out.where(F.col("type") == node_type) if node_type else out


def under(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.coalesce("path", F.lit("")).startswith(prefix))


def get(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def edge_details(graph: Graph, node_id: str) -> DataFrame:
    """direction, other, type, name, other_type, path, same_file for each edge of a node."""
    e = graph.edges
    out = e.where(F.col("source") == node_id).select(F.lit("out").alias("direction"), F.col("target").alias("other"), "type")
    into = e.where(F.col("target") == node_id).select(F.lit("in").alias("direction"), F.col("source").alias("other"), "type")
    own = get(graph.nodes, node_id).select(F.col("path").alias("_own"))
    meta = graph.nodes.select(F.col("id").alias("other"), "name", F.col("type").alias("other_type"), "path")
    told = out.unionByName(into).join(meta, "other", "left").crossJoin(F.broadcast(own.limit(1)))
    same = (F.coalesce("path", F.lit("")) != "") & F.col("path").eqNullSafe(F.col("_own"))
    return told.withColumn("same_file", same).drop("_own")


def connections(graph: Graph, node_id: str, lines: DataFrame, around: int = 1) -> DataFrame:
    """edge_details with a snippet: the lines (path, n, text) next to where the other end stands. A snippet that can't be
    made has an error instead."""
    told = edge_details(graph, node_id).join(
        graph.nodes.select(F.col("id").alias("other"), F.col("line_start").alias("line")), "other", "left"
    )
    text = lines.select(F.col("path").alias("_path"), "n", "text")
    near = told.join(
        text, (F.col("path") == F.col("_path")) & F.col("n").between(F.col("line") - around, F.col("line") + around), "left"
    )
    keys = ["direction", "other", "type", "name", "other_type", "path", "same_file", "line"]
    found = near.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "text")))).alias("snippet")
    )
    error = F.when(F.col("line").isNull(), "no line").when(F.size("snippet") == 0, "no source")
    return found.withColumn("error", error)


def defined_in(graph: Graph, node_id: str) -> DataFrame:
    """The node that defines the given one; the smallest id if several do."""
    first = (
        graph.edges.where((F.col("target") == node_id) & (F.col("type") == "defines"))
        .orderBy("source")
        .limit(1)
        .select(F.col("source").alias("id"))
    )
    return graph.nodes.join(F.broadcast(first), "id")


def children(graph: Graph, node_id: str, node_type: str | None = None) -> DataFrame:
    ids = graph.edges.where((F.col("source") == node_id) & F.col("type").isin("defines", "contains")).select(
        F.col("target").alias("id")
    )
    out = graph.nodes.join(ids.distinct(), "id", "left_semi")
    return out.where(F.col("type") == node_type) if node_type else out


def induced(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id)."""
    return graph.edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(
        ids.select(F.col("id").alias("target")), "target", "left_semi"
    )


def stats(graph: Graph) -> DataFrame:
    """kind (node or edge), type, n; the total has a null type."""
    both = graph.nodes.select(F.lit("node").alias("kind"), "type").unionAll(
        graph.edges.select(F.lit("edge").alias("kind"), "type")
    )
    both = both.withColumn("type", F.coalesce("type", F.lit("unknown")))
    return both.groupingSets([["kind", "type"], ["kind"]], "kind", "type").agg(F.count("*").alias("n"))


def tree(graph: Graph) -> DataFrame:
    """id, parent: directories and files by containment; roots have a null parent."""
    ids = graph.nodes.where(F.col("type").isin("directory", "file")).select("id", "type", "name", "path")
    up = graph.edges.where("type = 'contains'").select(F.col("target").alias("id"), F.col("source").alias("parent"))
    return ids.join(up, "id", "left")


def tree_counts(graph: Graph, depth: int | None = None) -> DataFrame:
    """parent, dirs, files: direct children of each folder, of those not deeper than ``depth``."""
    t = tree(graph).where("parent is not null")
    if depth is not None:
        t = t.where(F.size(F.split("path", "/")) <= depth)
    return t.groupBy("parent").agg(
        F.count_if(F.col("type") == "directory").alias("dirs"), F.count_if(F.col("type") == "file").alias("files")
    )


def lineage(paths: DataFrame) -> DataFrame:
    """Every directory above a file (path): path, parent, name. The root is the empty path."""
    parts = F.split("path", "/")
    up = paths.where(F.size(parts) > 1).select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        ).alias("path")
    )
    dirs = up.distinct()
    return dirs.select(
        "path",
        F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("parent"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
    )
