"""Vector search, and merges of several searches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.find import find
from tessera.schema import EMBEDDED_TYPES, MIN_EMBEDDED_CHARS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top(
    vectors: DataFrame, query: list[float], k: int = 10, node_type: str | None = None, drop_zero: bool = False
) -> DataFrame:
    """The k rows (id, embedding, type) with the highest cosine, ties by id. Rows of no length score 0, or are left out
    with drop_zero; then a query of no length finds nothing."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where("embedding is not null")
    rows = rows.where(F.col("type") == node_type) if node_type else rows
    if drop_zero:
        rows = rows.where(dot(F.col("embedding"), F.col("embedding")) > 0).where(F.lit(any(x != 0 for x in query)))
    return rows.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "id").limit(k)


class InvertedFile:
    """Approximate search: vectors dealt to sqrt(n) centres, the nearest of which are searched exactly.

    The centres are fitted on a sample of at most SAMPLE vectors; every vector is indexed. write() stores the vectors
    partitioned by centre, so a search reads only the probed partitions.
    """

    SAMPLE = 100_000
    #: Without a number of probes a search takes this share of the centres, LEAST_PROBES at least.
    PROBED, LEAST_PROBES = 0.6, 8

    def __init__(self, vectors: DataFrame, centres: int | None = None, seed: int = 42) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.linalg import Vectors

        rows = vectors.where("embedding is not null")
        n = rows.count()
        unit = rows.withColumn("_norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
        unit = unit.withColumn(
            "_unit",
            array_to_vector(
                F.when(
                    F.col("_norm") > 0, F.transform("embedding", lambda x: x.cast("double") / F.col("_norm"))
                ).otherwise(F.transform("embedding", lambda x: x.cast("double")))
            ),
        )
        fit = unit.sample(fraction=min(1.0, self.SAMPLE / n), seed=seed) if n > self.SAMPLE else unit
        self.k = centres or max(1, int(math.sqrt(n)))
        self.model = KMeans(k=max(2, self.k), seed=seed, featuresCol="_unit", predictionCol="centre", maxIter=10).fit(fit)
        self.centres = [c.tolist() for c in self.model.clusterCenters()]
        self.rows = self.model.transform(unit).drop("_unit", "_norm")
        self._vector = Vectors.dense

    def write(self, folder: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("centre").parquet(folder)

    def near(self, query: list[float], probes: int | None = None) -> list[int]:
        """The nearest centres, ``probes`` of them or as many as PROBED says."""
        norm = math.sqrt(sum(x * x for x in query)) or 1.0
        scored = sorted((sum((a / norm - b) ** 2 for a, b in zip(query, c, strict=True)), i) for i, c in enumerate(self.centres))
        most = probes or max(self.LEAST_PROBES, math.ceil(self.PROBED * len(self.centres)))
        return [i for _, i in scored[:most]]

    def search(self, query: list[float], k: int = 10, probes: int | None = None, rows: DataFrame | None = None) -> DataFrame:
        """The k best rows of the probed centres. rows: those written, read again."""
        return top((self.rows if rows is None else rows).where(F.col("centre").isin(self.near(query, probes))), query, k)


def merge_searches(searches: dict[str, DataFrame]) -> DataFrame:
    """id, matched (queries in order), score: the searches' rows (id, and score if there is one) in one list, best score
    first, then most queries, then id."""
    parts = [
        df.select(
            "id",
            F.lit(q).alias("query"),
            F.lit(k).alias("at"),
            (F.col("score") if "score" in df.columns else F.lit(0.0)).cast("double").alias("score"),
        )
        for k, (q, df) in enumerate(searches.items())
        if q
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    told = both.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("at", "query"))), lambda x: x["query"]).alias("matched"),
        F.max("score").alias("score"),
    )
    return told.orderBy(F.desc("score"), F.size("matched").desc(), "id")


def multi_find(nodes: DataFrame, queries: list[str], k: int = 10, node_type: str | None = None) -> DataFrame:
    """Several substring searches, k rows of each by id, merged."""
    return merge_searches({q: find(nodes, q, node_type).orderBy("id").limit(k).select("id") for q in queries if q})


def search(
    nodes: DataFrame, query: str, embed: Callable[[str], list[float]] | None, k: int = 10, node_type: str | None = None
) -> DataFrame:
    """Vector search if any node has an embedding and there is a model, else substring search."""
    if embed is not None and "embedding" in nodes.columns and not nodes.where("embedding is not null").isEmpty():
        return top(nodes, embed(query), k, node_type)
    return find(nodes, query, node_type).orderBy("id").limit(k).withColumn("score", F.lit(0.0))


def hashed_embedding(text: str, size: int = 64) -> list[float]:
    """A deterministic stand-in for a text model: signed word counts, of length 1."""
    v = [0.0] * size
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def embed_nodes(nodes: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """nodes with embedding set for those of an embedded type whose source, trimmed, has 40 characters or more. The
    model gets batches of texts."""
    embed = model or (lambda texts: [hashed_embedding(t) for t in texts])

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(text), dtype=object)
        have = text.notna()
        if have.any():
            out[have] = pd.Series(embed(text[have].tolist()), index=text[have].index, dtype=object)
        return out

    fit = F.col("type").isin(*EMBEDDED_TYPES) & (F.length(F.trim("source")) >= MIN_EMBEDDED_CHARS)
    return nodes.withColumn("embedding", run(F.when(fit, F.col("source"))))


def recall(found: DataFrame, exact: DataFrame) -> float:
    a, b = {r["id"] for r in found.collect()}, {r["id"] for r in exact.collect()}
    return len(a & b) / len(b) if b else 1.0

