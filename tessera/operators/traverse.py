"""Level-synchronous traversals: one job for each level, with the visited set kept out of the plan's lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph
from tessera.plans.scratch import BROADCAST_ROWS, cut

#: Levels after which what was reached is written as one table.
CUT_LEVELS = 8


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """here, there: the pairs that a traversal may follow."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    into = edges.select(F.col("target").alias("here"), F.col("source").alias("there"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def reach(pairs: DataFrame, starts: DataFrame, depth: int | None, *, emit_start: bool, by: str | None = None) -> DataFrame:
    """id, depth (and ``by``): what the starts (id, and ``by``) reach in at most ``depth`` steps, at its least depth.

    With emit_start a start isn't visited in advance: it is emitted if a cycle leads back to it. ``by`` names a column
    of starts that keeps several traversals apart. The frontier is broadcast only while it is small. A depth of None
    goes on until nothing new is found.
    """
    keys = ["id", *([by] if by else [])]
    frontier = cut(starts.select(*keys).distinct())
    if depth != 1:
        pairs = cut(pairs.distinct())  # each level reads the pairs, not what they were made of
    seen = frontier.withColumn("depth", F.lit(0))
    out, level = seen.limit(0), 0
    n = frontier.count()
    while n and (depth is None or level < depth):
        level += 1
        found = (
            (F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier)
            .join(pairs, F.col("id") == F.col("here"))
            .select(F.col("there").alias("id"), *keys[1:])
            .distinct()
        )
        known = out if emit_start else seen.unionByName(out)
        frontier = cut(found.join(known.select(*keys), keys, "left_anti") if level > 1 or not emit_start else found)
        n = frontier.count()
        if n:
            out = out.unionByName(frontier.withColumn("depth", F.lit(level)))
            # The plan of a long chain of levels stays as short as that of a few.
            out = cut(out) if level % CUT_LEVELS == 0 else out
    return out


def _start(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id).select("id")


def neighbors(
    graph: Graph, node_id: str, depth: int = 1, types: list[str] | None = None, direction: str = "both"
) -> DataFrame:
    """Nodes within ``depth`` steps along edges of the given types, with their depth; none for an unknown id."""
    ids = reach(steps(graph.of_types(types), direction), _start(graph, node_id), depth, emit_start=True)
    return ids.join(graph.nodes, "id")


def callers(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    return neighbors(graph, node_id, depth, ["calls"], "in")


def callees(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    return neighbors(graph, node_id, depth, ["calls"], "out")


def references(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    return neighbors(graph, node_id, depth)


def from_each(
    graph: Graph, starts: DataFrame, direction: str = "out", edge_type: str = "calls", depth: int = 1
) -> DataFrame:
    """origin, id, depth: one traversal from each start (id), which isn't emitted itself."""
    pairs = steps(graph.of_types([edge_type]), "out" if direction == "out" else "in")
    begin = starts.select("id", F.col("id").alias("origin"))
    return reach(pairs, begin, depth, emit_start=False, by="origin").select("origin", "id", "depth")


def affected(deps: DataFrame, dirty: DataFrame, hops: int = 1) -> DataFrame:
    """rel_path, hop: dirty files (rel_path) at hop 0 and what depends on them (file, dependent) within ``hops``."""
    begin = dirty.select(F.col("rel_path").alias("id")).distinct()
    pairs = deps.select(F.col("file").alias("here"), F.col("dependent").alias("there"))
    found = reach(pairs, begin, hops, emit_start=False)
    return begin.withColumn("depth", F.lit(0)).unionByName(found).select(
        F.col("id").alias("rel_path"), F.col("depth").alias("hop")
    )


def entry_depth(graph: Graph) -> DataFrame:
    """id, y: steps from the nodes that nothing calls, along calls and defines, scaled so that the deepest has 360;
    180 for what isn't reached, 0 if all are entries."""
    edges = cut(graph.of_types(["calls", "defines"]).select("source", "target", "type"))
    called = edges.where("type = 'calls'").select(F.col("target").alias("id")).distinct()
    entries = cut(graph.nodes.select("id").join(called, "id", "left_anti"))
    pairs = steps(edges, "out")
    depths = entries.distinct().withColumn("depth", F.lit(0)).unionByName(reach(pairs, entries, None, emit_start=False))
    depths = cut(depths)
    most = depths.agg(F.max("depth")).first()[0] or 0
    scaled = F.col("depth") / F.lit(float(most)) * 360.0 if most else F.lit(0.0)
    y = F.when(F.col("depth").isNull(), F.lit(180.0)).otherwise(scaled)
    return graph.nodes.select("id").join(depths, "id", "left").select("id", y.alias("y"))
