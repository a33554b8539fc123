"""Degrees, word clouds, PageRank, faces and capped sub-graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.find import induced, under
from tessera.operators.traverse import entry_depth
from tessera.plans.graph import Graph
from tessera.plans.scratch import cut
from tessera.schema import CLOUD_EXCLUDED

# How many words a cloud shows and from what strength, by mode.
CLOUD_MODES = {"strong": (30, 2), "relevant": (100, 2), "all": (500, 0)}
# The faces and the parts of paths that decide them, in order.
FACE_PATHS = (
    (6, ("test_", "_test", "/tests/")),
    (5, ("config", "settings", "env")),
    (4, ("util", "helper", "format", "common")),
    (3, ("storage", "db", "data", "model", "store")),
)


def degree(graph: Graph) -> DataFrame:
    """id, degree: edges in and out; one to itself counts twice; 0 without edges."""
    ends = graph.edges.select(F.col("source").alias("id")).unionAll(graph.edges.select("target"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return (
        graph.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    )


def word_cloud(graph: Graph, mode: str = "strong", path: str | None = None) -> DataFrame:
    """name, value, count, total: the strongest display names. total counts names before the cut."""
    top, least = CLOUD_MODES.get(mode.lower(), CLOUD_MODES["strong"])
    nodes = under(graph.nodes, path) if path else graph.nodes
    named = nodes.where(
        ~F.coalesce("type", F.lit("")).isin(*CLOUD_EXCLUDED) & (F.coalesce("name", F.lit("")) != "")
    )
    words = (
        named.select("id", "name")
        .join(degree(graph), "id")
        .groupBy("name")
        .agg(F.sum("degree").cast("double").alias("value"), F.count("*").alias("count"))
    )
    total = words.agg(F.count("*").alias("total"))
    shown = words.where(F.col("value") >= least).orderBy(F.desc("value"), "name").limit(top)
    return shown.crossJoin(F.broadcast(total))


def category_index(nodes: DataFrame) -> DataFrame:
    """type, category: types in order, from 0."""
    kinds = nodes.select(F.coalesce("type", F.lit("unknown")).alias("type")).distinct()
    return kinds.select("type", (F.dense_rank().over(Window.orderBy("type")) - 1).alias("category"))


def capped(
    graph: Graph,
    path: str | None = None,
    types: list[str] | None = None,
    edge_types: list[str] | None = None,
    limit: int = 2000,
    max_edges: int = 0,
) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes (id, type, degree, category, symbol_size), edges, and the totals with what was cut off: the ``limit`` nodes
    of highest degree (0: all), and of the edges between them the ``max_edges`` (0: three a node, 500 at least) with the
    largest sum of degrees. Ties go to the smaller id."""
    nodes = under(graph.nodes, path) if path else graph.nodes
    nodes = nodes.where(F.col("type").isin(list(types))) if types else nodes
    graph = Graph(graph.nodes, cut(graph.edges.select("source", "target", "type")))
    ranked = cut(nodes.select("id", "type", "name", "path").join(degree(graph), "id"))
    total = ranked.count()
    kept = cut(ranked.orderBy(F.desc("degree"), "id").limit(limit)) if limit and total > limit else ranked
    count = min(total, limit) if limit else total
    top = max(1, kept.agg(F.max("degree")).first()[0] or 1)
    size = F.least(F.greatest((10 + F.col("degree") / top * 40).cast("int"), F.lit(10)), F.lit(50))
    out = kept.join(F.broadcast(category_index(kept)), "type").withColumn("symbol_size", size)
    edges = induced(graph, kept)
    edges = edges.where(F.col("type").isin(list(edge_types))) if edge_types else edges
    edges = cut(edges.select("source", "target", "type"))
    most = max_edges if max_edges > 0 else max(count * 3, 500)
    total_edges = edges.count()
    if total_edges > most:
        d = kept.select("id", "degree")
        scored = edges.join(d.withColumnsRenamed({"id": "source", "degree": "_a"}), "source").join(
            d.withColumnsRenamed({"id": "target", "degree": "_b"}), "target"
        )
        edges = (
            scored.orderBy((F.col("_a") + F.col("_b")).desc(), "source", "target")
            .limit(most)
            .select("source", "target", "type")
        )
    told = {
        "total_nodes": total,
        "total_edges": total_edges,
        "truncated": total > count,
        "edges_truncated": total_edges > most,
    }
    return out, edges, told


def pagerank(graph: Graph, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """id, rank. Nodes without outgoing edges spread their rank evenly. Stops when the ranks' L1 change is under
    nodes * tol; with a tol of None it takes max_iter steps. One shuffle of the edges' ends a step, with partial sums."""
    edges = cut(graph.edges.select(F.col("source").alias("id"), "target"))
    out = edges.groupBy("id").agg(F.count("*").alias("_out"))
    ids = cut(
        graph.nodes.select("id").distinct().join(out, "id", "left").select("id", F.col("_out").isNull().alias("_end"))
    )
    n, ends = ids.agg(F.count("*"), F.count_if("_end")).first()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    # Edges that repeat are one row of their weight.
    weights = edges.groupBy("id", "target").agg(F.count("*").alias("_w")).join(out, "id")
    shares = cut(weights.select("id", "target", (F.col("_w") / F.col("_out")).alias("_w")))
    rank, lost = ids.withColumn("rank", F.lit(1.0 / n)), ends / n
    for _ in range(max_iter):
        given = (
            shares.join(rank.select("id", "rank"), "id")
            .groupBy(F.col("target").alias("id"))
            .agg(F.sum(F.col("rank") * F.col("_w")).alias("_in"))
        )
        base = (1 - alpha) / n + alpha * lost / n
        new = cut(
            rank.join(given, "id", "left").select(
                "id",
                "_end",
                F.col("rank").alias("_old"),
                (F.coalesce("_in", F.lit(0.0)) * alpha + base).alias("rank"),
            )
        )
        # One pass tells how far the ranks moved and what nodes without edges give to all in the next step.
        change, lost = new.agg(
            F.sum(F.abs(F.col("rank") - F.col("_old"))),
            F.coalesce(F.sum(F.when(F.col("_end"), F.col("rank"))), F.lit(0.0)),
        ).first()
        rank = new.drop("_old")
        if tol is not None and change < n * tol:
            return rank.select("id", "rank")
    if tol is not None:
        raise ValueError(f"PageRank hasn't converged in {max_iter} steps")
    return rank.select("id", "rank")


def min_max(df: DataFrame, column: str, out: str, scale: float = 1.0, flat: float = 0.0) -> DataFrame:
    """df with column scaled to 0..scale; ``flat`` if all values are equal."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    value = F.when(spread > 0, (F.col(column) - F.col("_lo")) / spread * scale).otherwise(flat)
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, value).drop("_lo", "_hi")


def importance(graph: Graph, **options) -> DataFrame:  # noqa: ANN003
    """id, z: PageRank scaled to 0..1."""
    return min_max(pagerank(graph, **options), "rank", "z").select("id", "z")


def face(kind: Column, path: Column, name: Column, called: Column, calls: Column) -> Column:
    """The face of a node, negative for private names."""
    low = F.lower(F.coalesce(path, F.lit("")))

    def holds(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    code = kind.isin("function", "method")
    (test, tests), *others = FACE_PATHS
    out = F.when(holds(tests) | low.startswith("tests/"), test)
    first, *more = others
    out = out.when(holds(first[1]), first[0]).when(kind == "variable", 5)
    for number, words in more:
        out = out.when(holds(words), number)
    out = out.when(~called & code, 1).when(called & calls, 2).when(code | (kind == "class"), 2).otherwise(1)
    private = F.coalesce(name.startswith("_") & ~name.startswith("__"), F.lit(False))
    return F.when(private, -out).otherwise(out)


def faces(graph: Graph) -> DataFrame:
    calls = graph.edges.where("type = 'calls'")
    into = calls.select(F.col("target").alias("id"), F.lit(True).alias("_called")).distinct()
    out = calls.select(F.col("source").alias("id"), F.lit(True).alias("_calls")).distinct()
    told = graph.nodes.select("id", "type", "path", "name").join(into, "id", "left").join(out, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.coalesce("type", F.lit(""))
    return told.select("id", face(kind, F.col("path"), F.col("name"), yes("_called"), yes("_calls")).alias("face"))


def projection(vectors: DataFrame, dimension: str = "embedding") -> DataFrame:
    """id, x: the first principal component scaled to 0..360; 180 if there is no spread.

    Only the moments reach the driver: d x d numbers, summed in the executors. Values that aren't finite count as 0. The
    sign is chosen so that the component's largest weight is positive.
    """
    clean = F.transform(
        F.col(dimension),
        lambda v: F.when(v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")), 0.0).otherwise(
            v.cast("double")
        ),
    )
    base = vectors.where(F.col(dimension).isNotNull()).select("id", clean.alias("v"))

    def moments(batches):  # noqa: ANN001, ANN202
        n, total, square = 0, None, None
        for b in batches:
            if b.num_rows:
                m = np.array(b.column("v").to_pylist(), float)
                n += len(m)
                total = m.sum(0) + (0 if total is None else total)
                square = m.T @ m + (0 if square is None else square)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.tolist()], "q": [square.ravel().tolist()]})

    parts = base.select("v").mapInArrow(moments, "n long, s array<double>, q array<double>").collect()
    n = sum(r["n"] for r in parts)
    if n < 2:
        return base.select("id", F.lit(180.0).alias("x"))
    mean = np.sum([r["s"] for r in parts], axis=0) / n
    cov = np.sum([r["q"] for r in parts], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    weights = F.array(*[F.lit(float(a)) for a in axis])
    dot = F.aggregate(F.zip_with("v", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return min_max(base.select("id", dot.alias("_dot")), "_dot", "x", 360.0, 180.0).select("id", "x")


def coordinates(graph: Graph, vectors: DataFrame | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Nodes' id and spatial (x, y, z, face). vectors: id, embedding; nodes without one have x 180."""
    have = vectors if vectors is not None else graph.nodes.select("id", "embedding")
    told = (
        graph.nodes.select("id")
        .join(projection(have), "id", "left")
        .join(entry_depth(graph), "id", "left")
        .join(importance(graph, **options), "id", "left")
        .join(faces(graph), "id", "left")
    )
    return told.select(
        "id",
        F.struct(
            F.coalesce("x", F.lit(180.0)).alias("x"),
            F.coalesce("y", F.lit(180.0)).alias("y"),
            F.coalesce("z", F.lit(0.0)).alias("z"),
            "face",
        ).alias("spatial"),
    )
