"""Streams of change events: filter, drop what is unchanged, debounce, apply."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Folders whose changes are never followed.
OWN_FOLDERS = ("__pycache__", "node_modules")


def relevant(changes: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Changes (path, ...) of files with one of the suffixes, if given, outside hidden and own folders."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*OWN_FOLDERS))
    out = changes.where(~hidden)
    return out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(suffixes)) if suffixes else out


def _drop_repeated(value: str, order: list[str]) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, ignore_index=True)
        before = rows[value].shift(1, fill_value=last)
        state.update((rows[value].iloc[-1],))
        yield rows[rows[value] != before]

    return run


def drop_repeated(stream: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value isn't that of the key's row before. Only the last value is kept as state, so one that comes back
    later is told again."""
    kept = stream.select(key, value, *order)
    return kept.groupBy(key).applyInPandasWithState(
        _drop_repeated(value, order), kept.schema, f"last {kept.schema[value].dataType.simpleString()}", "append", GroupStateTimeout.NoTimeout
    )


def debounce(stream: DataFrame, gap: str, *keys: str, late: str = "10 seconds") -> DataFrame:
    """window, paths, n: one row for each burst of changes (path, ts) that ``gap`` of quiet ends."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), *keys)
        .agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))
    )


def unchanged_dropped(events: DataFrame) -> tuple[DataFrame, str]:
    return drop_repeated(events, "user_id", "event_type", ["ts", "event_id"]), "append"


def debounced(events: DataFrame) -> tuple[DataFrame, str]:
    told = events.withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "10 minutes")).agg(
        F.count("*").alias("n")
    )
    return told.select("user_id", F.col("session_window.start").alias("begun"), "n"), "complete"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def replay(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], tuple[DataFrame, str]], *columns: str) -> DataFrame:
    """Runs the events table through a streaming query to its end and reads what it wrote."""
    path = f"{sf_dir}/events.parquet"
    # A stream reads folders or patterns; the pattern also fits a table that is one file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out, mode = of(events)
    folder = scratch(spark)

    def sink(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder; a complete result replaces the one before.
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        out.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*columns)
