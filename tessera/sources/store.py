"""Saved graphs: versions of tables, and JSON for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.graph import Graph
from tessera.schema import EDGE, NODE, conform


class Store:
    """A folder of versions. A version is current once its last file, a marker, is there, so a reader never sees half a
    version, and a job that is run again writes a new one. Nodes are partitioned by type and sorted by id."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _sub(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        found = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(v for v in found if self._fs.exists(self._sub(f"v={v}/DONE")))

    def save(self, tables: dict[str, DataFrame], keep: int = 2) -> int:
        """Writes a new version and drops those before the last ``keep``."""
        have = self.versions()
        v = (have[-1] if have else 0) + 1
        self._fs.delete(self._sub(f"v={v}"), True)
        for name, df in tables.items():
            out = df.sortWithinPartitions("id") if "id" in df.columns else df
            w = out.write.mode("overwrite")
            (w.partitionBy("type") if name == "nodes" else w).parquet(f"{self.folder}/v={v}/{name}")
        self._fs.create(self._sub(f"v={v}/DONE"), True).close()
        for old in have[: max(0, len(have) + 1 - keep)]:
            self._fs.delete(self._sub(f"v={old}"), True)
        return v

    def tables(self) -> list[str]:
        """The names of the current version's tables."""
        have = self.versions()
        if not have:
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._sub(f"v={have[-1]}")) if s.isDirectory())

    def load(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            raise FileNotFoundError(f"no version in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v={have[-1] if version is None else version}/{name}")

    def graph(self, embeddings: bool = True) -> Graph:
        nodes = self.load("nodes")
        return Graph(nodes if embeddings or "embedding" not in nodes.columns else nodes.drop("embedding"), self.load("edges"))

    def get(self, node_id: str) -> DataFrame:
        return self.load("nodes").where(F.col("id") == node_id)

    def save_graph(self, graph: Graph, **more: DataFrame) -> int:
        return self.save({"nodes": graph.nodes, "edges": graph.edges, **more})

    def save_diff(self, nodes: DataFrame, edges: DataFrame, gone_nodes: DataFrame, gone_edges: DataFrame, **more: DataFrame) -> int:
        """The current version with nodes and edges put in or replaced, and those gone (id; source, target) left out. The
        version's other tables stay as they are, unless ``more`` has them anew."""
        old = self.graph()
        drop = gone_nodes.select("id").union(nodes.select("id")).distinct()
        keys = ["source", "target"]
        drop_edges = gone_edges.select(keys).union(edges.select(keys)).distinct()
        return self.save(
            {
                "nodes": old.nodes.join(drop, "id", "left_anti").unionByName(nodes, allowMissingColumns=True),
                "edges": old.edges.join(drop_edges, keys, "left_anti").unionByName(edges, allowMissingColumns=True),
                **{t: self.load(t) for t in self.tables() if t not in ("nodes", "edges")},
                **more,
            }
        )

    def delete(self) -> None:
        self._fs.delete(self._path, True)


def write_json(graph: Graph, folder: str) -> None:
    """One JSON object a line, without nulls: folder/nodes and folder/edges."""
    graph.nodes.write.mode("overwrite").json(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").json(f"{folder}/edges")


def read_json(spark: SparkSession, folder: str, embeddings: bool = True) -> Graph:
    nodes = spark.read.schema(NODE).json(f"{folder}/nodes")
    return Graph(nodes if embeddings else nodes.drop("embedding"), spark.read.schema(EDGE).json(f"{folder}/edges"))


def read_document(spark: SparkSession, path: str, embeddings: bool = True) -> Graph:
    """A graph that is one JSON document with lists nodes and edges."""
    kind = f"nodes array<{NODE.simpleString()}>, edges array<{EDGE.simpleString()}>"
    doc = spark.read.schema(kind).json(path, multiLine=True)
    nodes = conform(doc.select(F.inline("nodes")), NODE)
    return Graph(nodes if embeddings else nodes.drop("embedding"), conform(doc.select(F.inline("edges")), EDGE))
