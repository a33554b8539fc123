"""Materialising intermediate tables, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of identifiers up to which a table is broadcast.
BROADCAST_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, which outlives any executor, and reads it back: ends its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-")
        )
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has ``most`` rows at most, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
