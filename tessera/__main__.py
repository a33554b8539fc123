"""python -m tessera: index a folder and ask its graph."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.encode import tabular
from tessera.operators import vector
from tessera.plans import ingest
from tessera.plans.enrich import enriched
from tessera.plans.knowledge import KnowledgeGraph
from tessera.plans.project import Project
from tessera.sources.store import Store


def _show(df: DataFrame, limit: int = 50) -> None:
    print(tabular([r.asDict(True) for r in df.limit(limit).collect()]))


def _index(spark: SparkSession, args: argparse.Namespace, project: Project, store: Store) -> None:
    old = store.versions() if args.incremental else []
    if old:
        before = ingest.Index(store.graph(), store.load("parsed"), {})
        index = ingest.update(before, spark, project.root, filters=project.as_filters())
    else:
        index = ingest.build(spark, project.root, filters=project.as_filters())
    graph = enriched(index.graph, before.graph if old else None, not args.no_embeddings, not args.no_spatial)
    store.save_graph(graph, parsed=index.parsed)
    project.record(index.stats)
    print(index.stats)


def _watch(spark: SparkSession, args: argparse.Namespace, project: Project, store: Store) -> None:
    from tessera.streaming import changes

    index = ingest.build(spark, project.root, filters=project.as_filters())
    folder = os.path.join(project.root, ".tessera")
    watcher = changes.Watcher(index, spark, project.root, on_update=print, enrich=enriched)
    stream = changes.file_changes(spark, project.root, os.path.join(folder, "snapshots"))
    watcher.start(stream, os.path.join(folder, "watch"), "1 second").awaitTermination()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--root", default=".", help="the project's folder")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("--incremental", action="store_true")
    a.add_argument("--no-embeddings", action="store_true")
    a.add_argument("--no-spatial", action="store_true")
    a = sub.add_parser("query")
    a.add_argument("name")
    a.add_argument("-t", "--type")
    a.add_argument("--callers", action="store_true")
    a.add_argument("--callees", action="store_true")
    a.add_argument("-d", "--depth", type=int, default=1)
    a = sub.add_parser("search")
    a.add_argument("text")
    a.add_argument("--top", type=int, default=10)
    a.add_argument("-t", "--type")
    sub.add_parser("watch")
    sub.add_parser("status")
    a = sub.add_parser("spatial")
    a.add_argument("--near")
    a.add_argument("--at", help="x,y")
    a.add_argument("--face", type=int)
    a.add_argument("--range", type=float, default=30.0)
    a.add_argument("--top", type=int, default=20)
    a = sub.add_parser("spatial-walk")
    a.add_argument("node_id")
    a.add_argument("--step", type=float, default=15.0)
    a.add_argument("--rings", type=int, default=4)
    a = sub.add_parser("inspect")
    a.add_argument("node_id")
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    project = Project.open(args.root)
    store = Store(spark, project.store)
    if args.command in ("index", "watch"):
        (_index if args.command == "index" else _watch)(spark, args, project, store)
        return
    kg = KnowledgeGraph(store.graph(), embed=vector.hashed_embedding)
    brief = ["id", "type", "name", "path", "line_start"]
    if args.command == "query":
        found = kg.find(args.name, args.type).select(brief)
        _show(found)
        for asked, of in ((args.callers, kg.callers), (args.callees, kg.callees)):
            for r in found.limit(5).collect() if asked else []:
                _show(of(r["id"], args.depth).select("depth", *brief))
    elif args.command == "search":
        _show(kg.search(args.text, args.top, args.type).select(*brief, "score"))
    elif args.command == "status":
        _show(kg.stats())
    elif args.command == "spatial":
        if args.near:
            found = kg.near(args.near, size=args.range, top=args.top)
        elif args.at:
            x, y = map(float, args.at.split(","))
            found = kg.in_range(x, y, args.range, top=args.top, face=args.face)
        elif args.face is not None:
            found = kg.on_face(args.face)
        else:
            p.error("one of --near, --at and --face is needed")
        _show(found.select(*brief, "spatial"), args.top)
    elif args.command == "spatial-walk":
        _show(kg.walk(args.node_id, step=args.step, rings=args.rings).select("ring", *brief).orderBy("ring", "id"))
    else:
        _show(kg.node(args.node_id).drop("embedding"))
        _show(kg.edges_of(args.node_id))


if __name__ == "__main__":
    main()
