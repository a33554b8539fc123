"""Queries on nodes' coordinates (spatial: x, y, z, face). Angles don't wrap at 360."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.traverse import from_each
from tessera.plans.graph import Graph


def _box(nodes: DataFrame, cx, cy, size: float, z_min: float, face: int | None) -> DataFrame:  # noqa: ANN001
    dx, dy = F.abs(F.col("spatial.x") - cx), F.abs(F.col("spatial.y") - cy)
    out = nodes.where((dx <= size) & (dy <= size) & (F.col("spatial.z") >= z_min))
    out = out.where(F.col("spatial.face") == face) if face is not None else out
    return out.withColumn("distance", dx + dy)


def in_range(
    nodes: DataFrame, cx: float, cy: float, size: float, z_min: float = 0.0, top: int = 20, face: int | None = None
) -> DataFrame:
    """Nodes in the box, nearest first by the sum of both distances, then by id; all of them if top isn't positive."""
    out = _box(nodes, cx, cy, size, z_min, face).orderBy("distance", "id")
    return out.limit(top) if top > 0 else out


def on_face(nodes: DataFrame, face: int) -> DataFrame:
    return nodes.where(F.col("spatial.face") == face).orderBy(F.col("spatial.z").desc(), "id")


def _centre(nodes: DataFrame, node_id: str) -> DataFrame:
    own = nodes.where((F.col("id") == node_id) & F.col("spatial").isNotNull())
    return F.broadcast(own.select(F.col("spatial.x").alias("_cx"), F.col("spatial.y").alias("_cy")).limit(1))


def near(nodes: DataFrame, node_id: str, size: float = 30.0, top: int = 20) -> DataFrame:
    """The box around a node, without it; nothing for an unknown node. The node itself takes part in the cut at top + 1."""
    around = _box(nodes.crossJoin(_centre(nodes, node_id)), F.col("_cx"), F.col("_cy"), size, 0.0, None)
    first = around.orderBy("distance", "id").limit(top + 1)
    return first.where(F.col("id") != node_id).orderBy("distance", "id").limit(top).drop("_cx", "_cy")


def walk(nodes: DataFrame, node_id: str, step: float = 15.0, rings: int = 5) -> DataFrame:
    """Nodes with their ring around a node: ring k holds what the box of k steps has and smaller boxes don't. One pass:
    the ring is the larger distance over the step, rounded up."""
    around = nodes.crossJoin(_centre(nodes, node_id)).where("spatial is not null")
    dx, dy = F.abs(F.col("spatial.x") - F.col("_cx")), F.abs(F.col("spatial.y") - F.col("_cy"))
    ring = F.when(F.col("id") == node_id, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.greatest(dx, dy) / step)))
    out = around.withColumns({"ring": ring.cast("int"), "distance": dx + dy})
    inside = (F.col("ring") <= rings) & ((F.col("spatial.z") >= 0) | (F.col("ring") == 0))
    return out.where(inside).drop("_cx", "_cy")


def with_neighbors(
    graph: Graph,
    cx: float,
    cy: float,
    size: float,
    direction: str = "out",
    edge_type: str = "calls",
    depth: int = 1,
    z_min: float = 0.0,
) -> DataFrame:
    """origin, id, depth: the nodes in a box (top 20) and what each reaches along one type of edge. Nodes without
    coordinates are walked through but not told."""
    starts = in_range(graph.nodes, cx, cy, size, z_min).select("id")
    found = from_each(graph, starts, direction, edge_type, depth)
    return found.join(graph.nodes.where("spatial is not null").select("id"), "id", "left_semi")
