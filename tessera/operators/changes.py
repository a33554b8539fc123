"""Differences between two states, dependencies between files, and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import file_of
from tessera.plans.graph import Graph
from tessera.schema import REINDEX_RUN


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, op: added, removed or modified. Rows are compared by a hash of all their other columns."""
    cols = sorted(set(old.columns) & set(new.columns) - {"id"})

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias(name))

    both = hashed(old, "_old").join(hashed(new, "_new"), "id", "full_outer")
    op = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "modified")
    )
    return both.select("id", op.alias("op")).where("op is not null")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, target, type, op: added or removed."""
    keys = ["source", "target", "type"]
    a, b = old.select(keys).distinct(), new.select(keys).distinct()
    side = a.withColumn("_s", F.lit(-1)).unionAll(b.withColumn("_s", F.lit(1)))
    net = side.groupBy(*keys).agg(F.sum("_s").alias("_s")).where("_s <> 0")
    return net.select(*keys, F.when(F.col("_s") > 0, "added").otherwise("removed").alias("op"))


def dirty_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path, op: added, modified or deleted, by sha256."""
    both = (
        old.select("rel_path", F.col("sha256").alias("_old"))
        .join(new.select("rel_path", F.col("sha256").alias("_new")), "rel_path", "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
    )
    op = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    return both.select("rel_path", op.alias("op"))


def to_read(old: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of a listing (rel_path, mtime_ns, size) whose stamp isn't that of the old state: only these are read."""
    return listing.join(old.select("rel_path", "mtime_ns", "size"), ["rel_path", "mtime_ns", "size"], "left_anti")


def dependencies(graph: Graph) -> DataFrame:
    """file, dependent: files whose nodes call or import nodes of another file."""
    pairs = graph.of_types(["calls", "imports"]).select(
        file_of(F.col("target")).alias("file"), file_of(F.col("source")).alias("dependent")
    )
    return pairs.where("file <> dependent").distinct()


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.sum("files_total"), F.lit(0)).alias("total_files_indexed"),
        F.coalesce(F.sum("edges_added"), F.lit(0)).alias("total_edges_added"),
        F.coalesce(F.sum("edges_removed"), F.lit(0)).alias("total_edges_removed"),
        F.array_join(F.sort_array(F.collect_set("strategy")), ",").alias("strategies"),
    )


def last_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    return runs.orderBy(F.desc("started_at")).limit(n)


def recorded(runs: DataFrame, run: dict, n: int = 100) -> DataFrame:
    """The history with one more run, of which the last n stay. run: the columns of REINDEX_RUN; missing ones are null."""
    row = tuple(run.get(f.name) for f in REINDEX_RUN)
    return last_runs(runs.unionByName(runs.sparkSession.createDataFrame([row], REINDEX_RUN)), n)


def next_strategy(runs: DataFrame, configured: str = "auto", foreground: bool = True, after: int = 50) -> str:
    """What the next run does: a full build once the last ``after`` runs were all incremental, else strategy()."""
    return "full" if force_full(runs, after).first()["force"] else strategy(configured, foreground)


def force_full(runs: DataFrame, after: int = 50) -> DataFrame:
    """force: whether the last ``after`` runs were all incremental."""
    return last_runs(runs, after).agg((F.count_if(F.col("strategy") != "full") >= after).alias("force"))


def strategy(configured: str, foreground: bool) -> str:
    """auto is local resolution in the foreground, full resolution in the background."""
    if configured != "auto":
        return configured
    return "resolve_local" if foreground else "resolve_full"


def last_per_key(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The n latest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
