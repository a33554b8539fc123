"""Embeddings and coordinates of a graph's nodes."""

from __future__ import annotations

from collections.abc import Callable

from tessera.operators import rank, vector
from tessera.plans.graph import Graph
from tessera.plans.scratch import cut


def enriched(
    graph: Graph,
    before: Graph | None = None,
    embeddings: bool = True,
    spatial: bool = True,
    model: Callable[[list[str]], list[list[float]]] | None = None,
) -> Graph:
    """graph with embeddings and coordinates. Nodes that have the same source in ``before`` keep the embedding that they
    have there, so the model sees what is new only; coordinates hang on the whole graph and are made anew."""
    nodes = graph.nodes
    if embeddings:
        nodes = nodes.drop("embedding")
        if before is not None and "embedding" in before.nodes.columns:
            old = before.nodes.where("embedding is not null").select("id", "source", "embedding")
            known = nodes.join(old, ["id", "source"])
            nodes = known.unionByName(vector.embed_nodes(nodes.join(old, ["id", "source"], "left_anti"), model))
        else:
            nodes = vector.embed_nodes(nodes, model)
        nodes = cut(nodes)
    if spatial:
        nodes = nodes.drop("spatial").join(rank.coordinates(Graph(nodes, graph.edges)), "id", "left")
    return Graph(nodes, graph.edges)
