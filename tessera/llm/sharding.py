"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, hot_join, numbered


def schedule(runs: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """LPT over runs of equal items. runs: (size, items). Returns size -> items for each shard.

    Runs are taken by falling size; each item goes to the least-loaded shard, ties to the lowest number. A long run is
    first laid up to a common level in one step, which places the same items as one step each would.
    """
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, items in sorted(runs, reverse=True):
        counts = [0] * shards
        if items > 4 * shards and size > 0:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            low, high = min(loads), min(loads) + size * (items + 1)

            def under(level: int, size: int = size, loads: list[int] = loads) -> list[int]:
                return [max(0, (level - load) // size) for load in loads]

            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if sum(under(mid)) <= items else (low, mid)
            counts = under(low)
            heap = [(load + counts[k] * size, k) for load, k in heap]
            heapq.heapify(heap)
        for _ in range(items - sum(counts)):
            load, k = heap[0]
            counts[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        out[size] = counts
    return out


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Rows with equal texts stay together; shards have nearly
    equal bytes (law ``bytes``), as far as the largest group allows.

    Groups of the same size are one run, whose items are dealt by their rank, so what reaches the driver is one row for
    each distinct size and partition, never one for each group: d distinct sizes take d * d / 2 bytes of text at least.
    Null and empty texts are one group, of size overhead each. Very long texts count whole. Of equal sizes, groups go by
    the hash of their text. Rows that repeat are each given a slot. An empty table gives an empty result. Other columns
    are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keys = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("_key"),
        )
    )
    groups = keys.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    ranked, runs = numbered(groups, "_bytes", ["_key"], "_rank")
    plan = []
    for size, counts in schedule(runs, shards).items():
        ends, at = [], 0
        for n in counts:
            at += n
            ends.append(at)
        plan.append((size, ends, at))
    spark = docs.sparkSession
    ends = cut(spark.createDataFrame(plan, "_bytes long, _ends array<long>, _n long"))
    placed = hot_join(ranked, ends, "_bytes", "_n", sum(n for _, n in runs)).select(
        "_key", "_rows", F.expr("size(filter(_ends, e -> e <= _rank))").cast("int").alias("shard")
    )
    told, _ = numbered(
        hot_join(keys, placed, "_key", "_rows", keys.count()).drop("_key"), "shard", ["doc_id", "text_crc32"], "slot"
    )
    return told.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
