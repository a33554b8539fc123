"""A stream of changes to a file tree, and what applies them to an index."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.graph import Graph
from tessera.plans.ingest import Index, update
from tessera.sources.files import TreeReader, _Top


class ChangeReader(SimpleDataSourceStreamReader):
    """Compares snapshots of the tree: a file source alone can't see deletions.

    The offset holds the number of the snapshot; the snapshots are files in the folder ``state``, so a restarted query
    goes on from its last one, and a batch that is read again gives the same rows. A move is a deletion and a creation.
    """

    def __init__(self, root: str, state: str) -> None:
        self.root, self.state = root, state
        os.makedirs(state, exist_ok=True)

    def _file(self, n: int) -> str:
        return os.path.join(self.state, f"{n}.json")

    def _load(self, n: int) -> dict:
        if not os.path.exists(self._file(n)):
            return {}
        with open(self._file(n)) as f:
            return json.load(f)

    def _now(self) -> dict:
        r = TreeReader(self.root, {".git", "__pycache__", "node_modules"})
        return {path: [mtime, size] for p in r.partitions() for path, mtime, size in r.read(p)}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new, n = self._load(start["n"]), self._now(), start["n"]
        if old == new:
            return iter(()), start
        temp = self._file(n + 1) + ".part"
        with open(temp, "w") as f:
            json.dump(new, f)
        os.replace(temp, self._file(n + 1))
        return self._diff(old, new), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._diff(self._load(start["n"]), self._load(end["n"]))

    def commit(self, end: dict) -> None:
        for n in range(max(0, end["n"] - 5), end["n"]):
            if os.path.exists(self._file(n)):
                os.remove(self._file(n))

    @staticmethod
    def _diff(old: dict, new: dict) -> Iterator[tuple]:
        at = int(time.time() * 1e6)
        rows = []
        for path in sorted({*old, *new}):
            if old.get(path) != new.get(path):
                op = "created" if path not in old else "deleted" if path not in new else "modified"
                rows.append((path, op, at))
        return iter(rows)


class ChangeSource(DataSource):
    """format("file_changes") with options path and state."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, op string, ts_micros long"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return ChangeReader(self.options["path"], self.options["state"])


def file_changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    """path, op, ts of files created, modified and deleted since the last look."""
    spark.dataSource.register(ChangeSource)
    raw = spark.readStream.format("file_changes").option("path", root).option("state", state).load()
    return raw.select("path", "op", F.timestamp_micros("ts_micros").alias("ts"))


class Watcher:
    """Keeps an index up to date with a stream of changes. Each trigger is one update of what changed since the last, so
    several changes of one file are one; a trigger without changes does nothing. on_update gets a message row.

    enrich: what gives a graph its embeddings and coordinates, as plans.enrich.enriched, of the new graph and the enriched
    one before; ``graph`` is its result, else the index's graph. The message is of the index, whose nodes don't move."""

    def __init__(self, index: Index, spark: SparkSession, root: str, strategy: str = "resolve_local", on_update: Callable[[dict], None] | None = None, enrich: Callable[[Graph, Graph | None], Graph] | None = None) -> None:
        self.index, self.spark, self.root, self.strategy, self.on_update = index, spark, root, strategy, on_update
        self.enrich = enrich
        self.graph = enrich(index.graph, None) if enrich else index.graph

    def apply(self, batch: DataFrame, number: int) -> None:
        told = {r["op"]: r["paths"] for r in batch.groupBy("op").agg(F.sort_array(F.collect_set("path")).alias("paths")).collect()}
        if not told:
            return
        before = self.index
        self.refresh(self.strategy)
        if self.on_update is not None:
            from tessera.operators.changes import node_diff

            diff = node_diff(before.graph.nodes, self.index.graph.nodes)
            by = {r["op"]: r["ids"] for r in diff.groupBy("op").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
            if by:
                self.on_update(
                    {
                        "type": "graph_update",
                        "updated_nodes": sorted([*by.get("added", []), *by.get("modified", [])]),
                        "removed_nodes": by.get("removed", []),
                        "changed_files": sorted([*told.get("created", []), *told.get("modified", [])]),
                        "deleted_files": told.get("deleted", []),
                    }
                )

    def refresh(self, strategy: str) -> None:
        self.index = update(self.index, self.spark, self.root, strategy)
        self.graph = self.enrich(self.index.graph, self.graph) if self.enrich else self.index.graph

    def start(self, changes: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """every: seconds between looks, as "1 second"; None takes what there is now and ends."""
        w = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def sweep(watcher: Watcher) -> None:
    """A full pass, for what a stream may have missed."""
    watcher.refresh("resolve_full")
