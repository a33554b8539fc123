"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII letters are lower-cased, other ASCII characters but digits become a blank; UTF-8 bytes from 0x80 up stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, which survives the loss of any executor, and reads it back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files that no table needs any more, which it does once the driver's
    collector has met them. A long operator calls it between its steps, so that disks don't hold all of them at once."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rows that Spark sends to Python at once. Its default of 10,000 documents fills large buffers outside of the heap.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH_ROWS, unless they are fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "0"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def map_batches(
    df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 512
) -> DataFrame:
    """mapInArrow in slices of at most ``rows`` rows. ``make`` runs once a task and returns the function of a slice,
    which returns columns by name."""
    lean(df.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = of(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type)
                        for f in arrow
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, kind)


#: Rows of a few numbers up to which a table is broadcast.
MOST_SENT = 500_000


def numbered(df: DataFrame, group: str, order: list[str | Column], out: str) -> tuple[DataFrame, list]:
    """Numbers the rows of each group from 0, without gaps, in the given order, with no task that holds a whole group.

    The rows are range-partitioned by (group, order), written, and numbered within their partition; the driver sees one
    row for each pair of group and partition, at most groups + partitions rows, which are returned too as
    (group, partition, rows, rows before). The caller bounds the number of groups.
    """
    spark = df.sparkSession
    flat = (
        df.repartitionByRange(partitions(spark), group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    flat = cut(flat)
    pid = F.shiftright("_mid", 33)
    starts = sorted(
        flat.groupBy(group, pid.alias("_pid")).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first")).collect(),
        key=lambda r: (r[0], r["_pid"]),
    )
    rows, before = [], {}
    for r in starts:
        rows.append((r[0], r["_pid"], r["_first"], before.get(r[0], 0)))
        before[r[0]] = before.get(r[0], 0) + r["_n"]
    kind = T.StructType(
        [T.StructField(group, df.schema[group].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("_pid", "_first", "_before")]
    )
    small = spark.createDataFrame(rows, kind)
    small = F.broadcast(small) if len(rows) <= MOST_SENT else small
    told = (
        flat.withColumn("_pid", pid)
        .join(small, [group, "_pid"])
        .withColumn(out, F.col("_mid") - F.col("_first") + F.col("_before"))
    )
    return told.drop("_mid", "_pid", "_first", "_before"), [(g, n) for g, n in before.items()]


#: A key with more than this share of all rows is hot; there are at most 1000 such keys, which bounds their broadcast.
HOT_SHARE = 0.001


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined to keyed, which has each key once, on key. weight: how many rows have the key; total: of all rows.
    Hot keys are joined by broadcast and so never meet in one task, the others by a shuffle."""
    most = max(1.0, HOT_SHARE * total)
    hot = F.broadcast(keyed.where(F.col(weight) > most).drop(weight))
    cold = keyed.where(F.col(weight) <= most).drop(weight)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def thin(df: DataFrame, ids: DataFrame, on: str, how: str, most: int = MOST_SENT) -> DataFrame:
    """df joined to the distinct ids by a semi or anti join: by broadcast up to ``most`` ids, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), on, how)
