"""Exact substring deduplication anchored on a difference cover."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import BLOCK_BYTES, block_of, edges_of, ids_of
from tessera.llm.common import map_batches, partitions
from tessera.llm.hashing import window_hashes, word_hashes

WINDOW = 20
#: A perfect difference set: for any i and j there is a k < PERIOD with i + k and j + k both in COVER modulo PERIOD.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: So two equal windows share an aligned anchor of this many words.
ANCHOR = WINDOW - PERIOD + 1
BUCKET_BYTES = 16 << 20
_PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


class Block:
    """The words of a block's documents in order of doc_id, with their hashes."""

    def __init__(self, doc_id: pa.Array, text: pa.Array) -> None:
        ids, texts = ids_of(doc_id), text.to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.doc_id = doc_id.take(pa.array(order, pa.int64()))
        self.texts = [texts[k] for k in order]
        self.n = np.array([t.count(b" ") + 1 if t else 0 for t in self.texts], np.int64)
        self.first = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.left = np.repeat(self.first + self.n, self.n) - np.arange(total)  # words from here to the document's end
        self.at = np.arange(total) - np.repeat(self.first, self.n)
        self.parts: list[tuple[int, np.ndarray]] = []  # hashes of runs of documents, to bound the working memory
        run, size, begun = [], 0, 0
        for t in [*self.texts, None]:
            if run and (t is None or size + len(t) > 1 << 19):
                hashes = word_hashes(b" ".join(run))
                self.parts.append((begun, hashes))
                begun += len(hashes)
                run, size = [], 0
            if t:
                run.append(t)
                size += len(t)

    def hashes(self, width: int, kind: int, where: np.ndarray) -> np.ndarray:
        """Window hashes at the word positions in where, which is sorted and holds only windows within a document."""
        out = np.empty(len(where), np.uint64)
        for begun, words in self.parts:
            lo, hi = np.searchsorted(where, (begun, begun + len(words)))
            if hi > lo:
                out[lo:hi] = window_hashes(words, width, kind)[where[lo:hi] - begun]
        return out

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys (bucket << 32 | hash) of the anchors in documents that hold a window."""
        holds = np.repeat(self.n >= WINDOW, self.n)
        where = np.flatnonzero(np.isin(self.at % PERIOD, COVER) & (self.left >= ANCHOR) & holds)
        h = self.hashes(ANCHOR, 0, where)
        return where, ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def spread(self, where: np.ndarray, before: int, after: int) -> np.ndarray:
        """Mask of the words from ``before`` words before to ``after`` words after each of the given positions."""
        delta = np.zeros(len(self.at) + 1, np.int64)
        np.add.at(delta, np.maximum(where - before, 0), 1)
        np.add.at(delta, np.minimum(where + after + 1, len(self.at)), -1)
        return np.cumsum(delta)[:-1] > 0

    def windows(self, where: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket and the 96-bit hash of the windows at the given positions."""
        out = np.empty(len(where), _PAIR)
        out["a"] = self.hashes(WINDOW, 0, where)
        out["b"] = (self.hashes(WINDOW, 1, where) >> np.uint64(32)).astype(np.uint32)
        return (out["a"] % np.uint64(buckets)).astype(np.int64), out


def _distinct(bucket: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of (bucket, hash, position); the first of each distinct hash; each row's distinct number."""
    order = np.lexsort((np.arange(len(pair)), pair["b"], pair["a"], bucket))
    p = pair[order]
    new = np.ones(len(p), bool)
    new[1:] = (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])
    return order, new, np.cumsum(new) - 1


def _rows(block: int, bucket: np.ndarray, data: np.ndarray) -> dict[str, list]:
    """A row for each bucket: bucket is sorted."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    ends = [*at[1:], len(bucket)][: len(at)]
    return {
        "block": [block] * len(at),
        "bucket": [int(bucket[a]) for a in at],
        "data": [data[a:b].tobytes() for a, b in zip(at, ends, strict=True)],
    }


_KIND = "block long, bucket long, data binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_TOLD = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.string()),
    ]
)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _flags(bucket: np.ndarray, flags: np.ndarray, told: pa.Table) -> np.ndarray:
    """Sets the flags of the distinct entries, which are in order of bucket, from the bitmaps that came back."""
    for b, data in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), strict=True):
        lo, hi = np.searchsorted(bucket, (b, b + 1))
        flags[lo:hi] |= np.unpackbits(np.frombuffer(data, np.uint8), count=int(hi - lo)).astype(bool)
    return flags


def repeats(docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept): words under a window of WINDOW words whose sequence also
    starts earlier, in a smaller doc_id or earlier in the same document, are removed.

    Words are runs without ASCII white space. Documents are dealt into blocks by doc_id. Each block sends the distinct
    hashes of its anchors, ANCHOR words at positions in COVER modulo PERIOD, and gets a bitmap back that tells which
    stand in other blocks too. Shared anchors extend to windows, whose 96-bit hashes go the same way; the bitmap then
    tells which stand in an earlier block. A hash that is very frequent is one entry for each block, never one for each
    occurrence, and no pairs are made. Texts are shuffled once: the three passes read the same exchange.

    Null and empty texts have no words and an empty kept text. Rows that repeat a doc_id are taken in order of their
    texts. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    edges, total = edges_of(docs, block_bytes)
    shared = spark.sparkContext.broadcast(edges)
    buckets = max(partitions(spark), total // 5 // BUCKET_BYTES)

    def make():  # noqa: ANN202
        cuts = shared.value

        def of(batch: pa.RecordBatch) -> dict:
            flat = [b" ".join(t.encode().split()) if t else b"" for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "words": flat,
                "block": block_of(cuts, ids_of(batch.column("doc_id"))),
            }

        return of

    words = map_batches(docs, "doc_id long, words binary, block long", make)
    by_block = words.groupBy("block")

    def send_anchors(t: pa.Table) -> pa.Table:
        block = Block(_column(t, "doc_id"), _column(t, "words"))
        key = np.unique(block.anchors(buckets)[1])
        rows = _rows(t["block"][0].as_py(), (key >> np.uint64(32)).astype(np.int64), key.astype("<u4"))
        return pa.Table.from_pydict(rows, _SCHEMA)

    def common(t: pa.Table) -> pa.Table:
        """Which entries stand in more than one row; a row's entries are distinct."""
        parts = [np.frombuffer(x, "<u4") for x in t.column("data").to_pylist()]
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        return _back(t, parts, counts[inverse] > 1)

    def _back(t: pa.Table, parts: list[np.ndarray], flag: np.ndarray) -> pa.Table:
        ends = np.cumsum([len(x) for x in parts])
        bits = np.split(flag, ends[:-1])
        keep = [k for k, x in enumerate(bits) if x.any()]
        return pa.Table.from_pydict(
            {
                "block": [t.column("block")[k].as_py() for k in keep],
                "bucket": [t.column("bucket")[k].as_py() for k in keep],
                "data": [np.packbits(bits[k]).tobytes() for k in keep],
            },
            _SCHEMA,
        )

    def send_windows(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_pydict({n: [] for n in _SCHEMA.names}, _SCHEMA)
        number = t["block"][0].as_py()
        block = Block(_column(t, "doc_id"), _column(t, "words"))
        where, key = block.anchors(buckets)
        distinct, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        flags = _flags((distinct >> np.uint64(32)).astype(np.int64), counts > 1, told)
        mask = block.spread(where[flags[inverse]], PERIOD - 1, 0) & (block.left >= WINDOW)
        bucket, pair = block.windows(np.flatnonzero(mask), buckets)
        order, new, _ = _distinct(bucket, pair)
        rows = _rows(number, bucket[order][new], pair[order][new])
        # The mask goes along as a bucket of its own, so that the last pass needn't be told the anchors again.
        rows["block"].append(number)
        rows["bucket"].append(-1 - number)
        rows["data"].append(np.packbits(mask).tobytes())
        return pa.Table.from_pydict(rows, _SCHEMA)

    def earlier(t: pa.Table) -> pa.Table:
        """Which entries stand in a row of a smaller block too."""
        if t["bucket"][0].as_py() < 0:
            return t.select(_SCHEMA.names)
        t = t.sort_by("block")
        parts = [np.frombuffer(x, _PAIR) for x in t.column("data").to_pylist()]
        pair = np.concatenate(parts)
        order, new, _ = _distinct(np.zeros(len(pair), np.int64), pair)
        flag = np.empty(len(pair), bool)
        flag[order] = ~new
        return _back(t, parts, flag)

    def remove(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_pydict({n: [] for n in _TOLD.names}, _TOLD)
        block = Block(_column(t, "doc_id"), _column(t, "words"))
        own = pa.compute.less(told["bucket"], 0)
        mask = np.unpackbits(
            np.frombuffer(told.filter(own)["data"][0].as_py(), np.uint8), count=len(block.at)
        ).astype(bool)
        where = np.flatnonzero(mask)
        bucket, pair = block.windows(where, buckets)
        order, new, number = _distinct(bucket, pair)
        flags = _flags(bucket[order][new], np.zeros(int(new.sum()), bool), told.filter(pa.compute.invert(own)))
        gone = np.empty(len(pair), bool)
        gone[order] = flags[number] | ~new
        dropped = block.spread(where[gone], 0, WINDOW - 1)
        out: dict[str, list] = {n: [] for n in _TOLD.names}
        for k, (text, a, n) in enumerate(zip(block.texts, block.first, block.n, strict=True)):
            here = dropped[a : a + n]
            removed = int(here.sum())
            if removed:
                text = b"" if removed == n else b" ".join(compress(text.split(b" "), (~here).tolist()))
            out["doc_id"].append(block.doc_id[k].as_py())
            out["n_words"].append(int(n))
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["kept"].append(text.decode() if with_text else None)
        return pa.Table.from_pydict(out, _TOLD)

    anchors = by_block.applyInArrow(send_anchors, _KIND).groupBy("bucket").applyInArrow(common, _KIND)
    windows = by_block.cogroup(anchors.groupBy("block")).applyInArrow(send_windows, _KIND)
    told = windows.groupBy("bucket").applyInArrow(earlier, _KIND)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(remove, kind)
    return out if with_text else out.drop("kept")
