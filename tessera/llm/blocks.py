"""Blocks of documents: ranges of doc_id with about as much text each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

BLOCK_BYTES = 8 << 20
#: Blocks grow beyond their least size, up to 64 MB, before there are more than so many of them.
BLOCKS, LARGEST = 500_000, 64 << 20
#: Ranges of doc_id whose bytes are counted at first, and into which one that is too large is cut.
RANGES, CUTS = 4096, 64


def edges_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, int]:
    """The largest doc_id of each block but the last, and the bytes of all texts.

    Blocks have up to ``block_bytes`` of text, or more of it where the corpus is large: 100 TB have some 2 million
    blocks, 64 MB each. Bytes are counted by ranges of doc_id, and ranges with too many are cut and counted again, so
    neither gaps in the doc_ids nor runs of long texts make a large block; only rows of one doc_id stay together. The
    driver sees one number for each range. Null doc_ids come before all others.
    """
    sizes = cut(docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("b")))
    low, high, total = sizes.agg(F.min("doc_id"), F.max("doc_id"), F.sum("b")).first()
    total = total or 0
    wanted = max(block_bytes, min(LARGEST, total // BLOCKS))
    if total <= wanted or low is None:
        return np.empty(0, np.int64), total
    low, high = int(low), int(high)
    # Range k holds the doc_ids above ends[k - 1] up to ends[k]; null ones are in the first.
    ends = _split(low - 1 if low > -(1 << 63) else low, high, RANGES)
    while True:
        told = _bytes(sizes, ends)
        wide = np.diff(ends, prepend=low - 1 if low > -(1 << 63) else low) > 1
        heavy = np.flatnonzero((told > wanted / 4) & wide & (told > 0))
        heavy = heavy[told[heavy] > wanted]
        if not len(heavy):
            break
        more = [_split(int(ends[k - 1]) if k else low - 1, int(ends[k]), CUTS) for k in heavy.tolist()]
        ends = np.unique(np.concatenate([ends, *more]))
    out, held = [], 0
    for k, n in enumerate(told.tolist()):
        if held and held + n > wanted:
            out.append(int(ends[k - 1]))
            held = 0
        held += n
    return np.array(out, np.int64), total


def _split(before: int, last: int, parts: int) -> np.ndarray:
    """The ends of at most ``parts`` ranges that cover the numbers above ``before`` up to ``last``."""
    n = min(parts, last - before)
    return np.unique(np.array([before + (last - before) * k // n for k in range(1, n + 1)], np.int64))


def _bytes(sizes: DataFrame, ends: np.ndarray) -> np.ndarray:
    """The bytes of each range."""
    shared = sizes.sparkSession.sparkContext.broadcast(ends)

    def add(batches):  # noqa: ANN001, ANN202
        for b in batches:
            k = np.searchsorted(shared.value, ids_of(b.column("doc_id")))
            n = np.bincount(k, weights=b.column("b").to_numpy())
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": at.astype(np.int64), "n": n[at].astype(np.int64)})

    rows = sizes.mapInArrow(add, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    out = np.zeros(len(ends), np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def block_of(edges: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, ids).astype(np.int64)
