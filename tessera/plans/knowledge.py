"""One object with all that can be asked of a graph; every method returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.operators import changes, find, notes, rank, spatial, text, traverse, vector
from tessera.plans.graph import Graph


class KnowledgeGraph:
    """texts (path, content) serves the searches in sources; embed turns a question into a vector."""

    def __init__(self, graph: Graph, texts: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None) -> None:
        self.graph, self.texts, self.embed = graph, texts, embed

    def find(self, name: str, node_type: str | None = None) -> DataFrame:
        return find.find(self.graph.nodes, name, node_type)

    def search(self, query: str, k: int = 10, node_type: str | None = None) -> DataFrame:
        return vector.search(self.graph.nodes, query, self.embed, k, node_type)

    def search_multi(self, queries: list[str], k: int = 10, node_type: str | None = None) -> DataFrame:
        return vector.merge_searches({q: self.search(q, k, node_type) for q in queries if q})

    def node(self, node_id: str) -> DataFrame:
        return find.get(self.graph.nodes, node_id)

    def edges_of(self, node_id: str) -> DataFrame:
        return find.edge_details(self.graph, node_id)

    def connections(self, node_id: str) -> DataFrame:
        return find.connections(self.graph, node_id, text.lines(self.texts))

    def callers(self, node_id: str, depth: int = 1) -> DataFrame:
        return traverse.callers(self.graph, node_id, depth)

    def callees(self, node_id: str, depth: int = 1) -> DataFrame:
        return traverse.callees(self.graph, node_id, depth)

    def references(self, node_id: str, depth: int = 1) -> DataFrame:
        return traverse.references(self.graph, node_id, depth)

    def neighbors(self, node_id: str, depth: int = 1, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        return traverse.neighbors(self.graph, node_id, depth, types, direction)

    def defined_in(self, node_id: str) -> DataFrame:
        return find.defined_in(self.graph, node_id)

    def children(self, node_id: str, node_type: str | None = None) -> DataFrame:
        return find.children(self.graph, node_id, node_type)

    def stats(self) -> DataFrame:
        return find.stats(self.graph)

    def tree(self) -> DataFrame:
        return find.tree(self.graph)

    def word_cloud(self, mode: str = "strong", path: str | None = None) -> DataFrame:
        return rank.word_cloud(self.graph, mode, path)

    def capped(self, **options) -> tuple[DataFrame, DataFrame, dict]:  # noqa: ANN003
        return rank.capped(self.graph, **options)

    def coordinates(self, **options) -> DataFrame:  # noqa: ANN003
        return rank.coordinates(self.graph, **options)

    def in_range(self, cx: float, cy: float, size: float, **options) -> DataFrame:  # noqa: ANN003
        return spatial.in_range(self.graph.nodes, cx, cy, size, **options)

    def on_face(self, face: int) -> DataFrame:
        return spatial.on_face(self.graph.nodes, face)

    def near(self, node_id: str, **options) -> DataFrame:  # noqa: ANN003
        return spatial.near(self.graph.nodes, node_id, **options)

    def walk(self, node_id: str, **options) -> DataFrame:  # noqa: ANN003
        return spatial.walk(self.graph.nodes, node_id, **options)

    def in_range_with_neighbors(self, cx: float, cy: float, size: float, **options) -> DataFrame:  # noqa: ANN003
        return spatial.with_neighbors(self.graph, cx, cy, size, **options)

    def file_stats(self) -> DataFrame:
        return text.file_stats(self.texts, self.graph.nodes)

    def file_section(self, path: str, start: int, end: int, md5: str | None = None) -> DataFrame:
        """Lines of a file; with md5 only if the file is still the one that was read before."""
        return text.section(text.checked(self.texts, path, md5), path, start, end)

    def file_content(self, path: str) -> DataFrame:
        return text.content(self.texts, path)

    def function_source(self, path: str, name: str, md5: str | None = None) -> DataFrame:
        """Lines and source of the functions, methods or classes of that name in a file; Class.method means a method of
        that class. NotFoundError if there is none."""
        if md5 is not None:
            text.checked(self.texts, path, md5)
        n = self.graph.nodes
        owner, _, last = name.rpartition(".")
        named = (n["path"] == path) & (n["name"] == last) & n["type"].isin("function", "method", "class")
        if owner:
            named = named & (n["parent_class"] == owner)
        found = n.where(named).select("id", "type", "line_start", "line_end", "source")
        if found.isEmpty():
            raise text.NotFoundError(f"no function, method or class {name} in {path}")
        return found

    def file_search(self, path: str, pattern: str, regex: bool = True, context: int = 5) -> DataFrame:
        return text.grep(self.texts.where(self.texts["path"] == path), pattern, regex, context)

    def project_search(self, pattern: str, globs: str = "*.py", regex: bool = True, context: int = 5) -> DataFrame:
        return text.project_grep(self.texts, pattern, globs, regex, context)

    def dependencies(self) -> DataFrame:
        return changes.dependencies(self.graph)

    def notes_by_target(self, annotations: DataFrame, file_path: str | None = None, node_id: str | None = None) -> DataFrame:
        return notes.by_target(annotations, file_path, node_id)

    def notes_by_tag(self, annotations: DataFrame, tag: str) -> DataFrame:
        return notes.by_tag(annotations, tag)
