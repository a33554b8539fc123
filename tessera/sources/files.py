"""File trees as tables.

Spark's own file sources pass over names that begin with _ or ., so a tree on a mounted file system is listed by a Python
data source with one partition for each top-level entry; other stores are read by the binaryFile source.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.paths import base_name, directory, glob_regex, suffix
from tessera.schema import EDGE, NODE, struct
from tessera.sources import parsers as registry
from tessera.sources.parsers.base import Parser

LISTING = "rel_path string, mtime_ns long, size long"


@dataclass
class _Top(InputPartition):
    name: str


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: set[str]) -> None:
        self.root, self.skip = root, skip

    def partitions(self) -> list[InputPartition]:
        return [_Top(n) for n in sorted(os.listdir(self.root))] or [_Top("")]

    def read(self, partition: _Top) -> Iterator[tuple]:
        top = os.path.join(self.root, partition.name)
        if not partition.name or partition.name in self.skip:
            return
        found = [(self.root, [], [partition.name])] if os.path.isfile(top) else os.walk(top)
        for folder, dirs, files in found:
            dirs[:] = sorted(d for d in dirs if d not in self.skip)  # not walked into
            for f in sorted(files):
                full = os.path.join(folder, f)
                try:
                    s = os.stat(full)
                except OSError:  # gone meanwhile
                    continue
                yield os.path.relpath(full, self.root).replace(os.sep, "/"), s.st_mtime_ns, s.st_size


class TreeSource(DataSource):
    """format("file_tree") with options path and skip (folder names, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TreeReader(self.options["path"], {s for s in self.options.get("skip", "").split(",") if s})


def listing(spark: SparkSession, root: str, skip: set[str] | None = None) -> DataFrame:
    """rel_path, mtime_ns, size of every file, contents unread. Folders named in skip aren't entered."""
    if re.match(r"^(?!file:)[a-zA-Z][\w+.-]*://", root):
        base = root.rstrip("/") + "/"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        at = F.instr("path", base.split("://", 1)[1])
        return files.select(
            F.substr("path", at + len(base.split("://", 1)[1]), F.length("path")).alias("rel_path"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
            F.col("length").alias("size"),
        )
    spark.dataSource.register(TreeSource)
    local = root.removeprefix("file://")
    return spark.read.format("file_tree").option("path", local).option("skip", ",".join(sorted(skip or ()))).load()


@dataclass(frozen=True)
class Filters:
    """What a user wants indexed. mode custom: only include_dirs, if there are any."""

    mode: str = "all"
    include_dirs: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    include_types: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def kept(files: DataFrame, parsers: list[Parser], filters: Filters | None = None) -> DataFrame:
    """Files outside hidden, ignored and marked folders that pass the filters. All is one predicate on rel_path, but for
    marked folders (virtual environments), which an anti join on the few marker files' folders takes out."""
    dirs, globs, marks = registry.ignored(parsers)
    path = F.col("rel_path")
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    names = F.array(*[F.lit(d) for d in sorted(dirs)])
    base = base_name(path)
    bad = F.exists(folders, lambda p: p.startswith(".")) | F.arrays_overlap(folders, names) | base.startswith(".")
    out = files.where(~bad & ~any_of([base.rlike(glob_regex(g)) for g in globs]))
    marked = files.where(base.isin(*marks) if marks else F.lit(False)).select(directory(path).alias("_dir")).where("_dir <> ''")
    inside = [F.explode(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, 1, k), "/")))]
    under = files.where(F.size(folders) > 0).select("rel_path", inside[0].alias("_dir"))
    out = out.join(under.join(F.broadcast(marked.distinct()), "_dir", "left_semi").select("rel_path").distinct(), "rel_path", "left_anti")
    if filters is None:
        return out
    folder = directory(path)
    for d in (x.strip("/") for x in filters.exclude_dirs):
        whole = F.concat(folder, F.lit("/"))
        out = out.where(~(whole.startswith(f"{d}/") | F.array_contains(folders, d)))
    if filters.mode == "custom" and filters.include_dirs:
        wanted = [F.concat(folder, F.lit("/")).startswith(f"{d.strip('/')}/") for d in filters.include_dirs]
        # Folders above an included one are walked through, so their own files count too.
        above = [F.concat(F.lit(d.strip("/")), F.lit("/")).startswith(F.concat(folder, F.lit("/"))) for d in filters.include_dirs]
        out = out.where(any_of([*wanted, *above]) | (folder == ""))
    out = out.where(~any_of([path.rlike(glob_regex(g)) | base.rlike(glob_regex(g)) for g in filters.exclude_globs]))
    if filters.include_types:
        out = out.where(suffix(path).isin(*[t.lower().lstrip(".") for t in filters.include_types]))
    return out


CALL = struct("caller string, path string, name string, args array<string>, line int")
IMPORT = struct("path string, module string, names array<string>, alias string, line int")
PARSED = T.StructType(
    [
        *struct("rel_path string, sha256 string, mtime_ns long, size long, parser string, error string"),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("edges", T.ArrayType(EDGE)),
        T.StructField("calls", T.ArrayType(CALL)),
        T.StructField("imports", T.ArrayType(IMPORT)),
    ]
)


def _row(path: str, raw: bytes, mtime_ns: int, size: int, parsers: list[Parser]) -> dict:
    p = registry.dispatch(path, parsers)
    text = raw.decode("latin-1") if p and p.name == "pdf_pypdf" else raw.decode("utf-8", "replace")
    found, parser, error = registry.parse(path, text, parsers)
    nodes, edges, calls, imports = registry.rows(path, found, hashlib.md5(raw).hexdigest())
    names = {f.name for f in NODE}
    return {
        "rel_path": path, "sha256": hashlib.sha256(raw).hexdigest(), "mtime_ns": mtime_ns, "size": size, "parser": parser, "error": error,
        "nodes": [{k: v for k, v in n.items() if k in names} for n in nodes], "edges": edges, "calls": calls, "imports": imports,
    }


def parse_texts(texts: DataFrame, parsers: list[Parser]) -> DataFrame:
    """parse() of files whose contents are at hand: texts (path, content). Null contents are empty; stamps are 0."""
    arrow = to_arrow_schema(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = (row["content"] or "").encode("utf-8", "replace")
                yield pa.RecordBatch.from_pylist([_row(row["path"], raw, 0, len(raw), parsers)], schema=arrow)

    return texts.select("path", "content").mapInArrow(run, PARSED)


def parse(files: DataFrame, root: str, parsers: list[Parser]) -> DataFrame:
    """One row for each file (rel_path, mtime_ns, size) with what its parser found. Each file is read once, for its hash
    and its parse. A file without a parser, or that can't be parsed, is still a file node; what went wrong stands in
    error. A file that is gone meanwhile has no row."""
    arrow = to_arrow_schema(PARSED)
    local = root.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = row["rel_path"]
                try:
                    with open(os.path.join(local, path), "rb") as f:
                        raw = f.read()
                except OSError:
                    continue
                told = _row(path, raw, row["mtime_ns"], row["size"], parsers)
                yield pa.RecordBatch.from_pylist([told], schema=arrow)

    return files.select("rel_path", "mtime_ns", "size").mapInArrow(run, PARSED)


def browse(path: str) -> list[str]:
    """Folders in a folder, hidden ones left out, in order of their lower-case names."""
    found = [e.name for e in os.scandir(path) if e.is_dir() and not e.name.startswith(".")]
    return sorted(found, key=str.lower)


def allowed(path: str, roots: list[str]) -> bool:
    """Whether a path, with links followed, lies in one of the roots."""
    real = os.path.realpath(path)
    return any(real == (r := os.path.realpath(x)) or real.startswith(r.rstrip("/") + "/") for x in roots)
