"""The property graph and its uniqueness rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import EDGE_PHASE


@dataclass(frozen=True)
class Graph:
    """nodes has id, type, name, path and what else a node may have; edges has source, target, type."""

    nodes: DataFrame
    edges: DataFrame

    def of_types(self, types: list[str] | None) -> DataFrame:
        """Edges of the given types; all if types is None or empty."""
        return self.edges.where(F.col("type").isin(list(types))) if types else self.edges


def phase(kind: Column) -> Column:
    out = F.lit(-1)
    for name, k in EDGE_PHASE.items():
        out = F.when(kind == name, k).otherwise(out)
    return out


def unique_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge for each (source, target): that of the latest phase, then of the largest ``order``, then type.

    A grouped maximum of a struct, so copies meet in a partial aggregate before the shuffle.
    """
    rest = [c for c in edges.columns if c not in ("source", "target")]
    rank = [phase(F.col("type")).alias("_phase"), *([F.col(order).alias("_order")] if order else [])]
    best = F.max(F.struct(*rank, *rest))
    return (
        edges.groupBy("source", "target").agg(best.alias("_e")).select("source", "target", *[f"_e.{c}" for c in rest])
    )


def unique_nodes(nodes: DataFrame, seq: str) -> DataFrame:
    """One row for each id. Later rows, by seq, overwrite what they have; what they lack stays."""
    last = Window.partitionBy("id").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [c for c in nodes.columns if c not in ("id", seq)]
    merged = nodes.select("id", seq, *[F.last(c, ignorenulls=True).over(last).alias(c) for c in names])
    top = F.row_number().over(Window.partitionBy("id").orderBy(F.col(seq).desc()))
    return merged.withColumn("_n", top).where("_n = 1").drop("_n", seq)
