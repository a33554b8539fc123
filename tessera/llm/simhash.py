"""SimHash fingerprints and the search within a Hamming radius."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import block_of, edges_of, ids_of
from tessera.llm.common import map_batches, words_of
from tessera.llm.hashing import mix, shingles, word_hashes

BITS = 256
#: Text of a block at least. Small blocks even out the tasks that they are dealt to.
BLOCK_BYTES = 1 << 20
RADIUS = 7
#: Terms whose bits are held at once, which bounds the memory of a long text.
PART = 1 << 14
_SEEDS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0x510E527FADE682D1], np.uint64)
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1
_PLACE = (np.arange(BITS // 8) * 256).astype(np.int64)


def fingerprint(text: str | None) -> str:
    """64 hex digits. Each five-word run of the folded text, as often as it stands, votes with its hash's 256 signed
    bits; texts of fewer words have one term, texts without words the fingerprint of all zeros, as have null ones."""
    terms = shingles(word_hashes(b" ".join(words_of(text))))
    if not len(terms):
        return "0" * (BITS // 4)
    counts = np.zeros(BITS // 8 * 256, np.int64)
    for at in range(0, len(terms), PART):
        bits = mix(terms[at : at + PART, None] ^ _SEEDS).view(np.uint8).reshape(-1, BITS // 8)
        counts += np.bincount((bits + _PLACE).ravel(), minlength=len(counts))
    return np.packbits(counts.reshape(BITS // 8, 256) @ _SIGNS > 0).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The cosine that the share of equal bits stands for, 0 at least."""
    apart = (int(a, 16) ^ int(b, 16)).bit_count()
    return 1.0 if not apart else max(0.0, math.cos(math.pi * apart / BITS))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the first as many characters of ``after``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, of the whole text of each row; null texts count as empty."""

    def make():  # noqa: ANN202
        return lambda b: {"doc_id": b.column(0), "fingerprint": [fingerprint(t) for t in b.column(1).to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fingerprint string", make)


_KIND = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compare(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next doc_id, after the last the first; rows that repeat a doc_id follow each
    other in order of their texts; null doc_ids come first. Documents are dealt into blocks by doc_id, and each block
    also gets the first document of the next, so texts are shuffled once and no task holds all. The driver gets one
    doc_id for each block.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    edges, _ = edges_of(base, block_bytes)
    low = base.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    # The doc_ids that a block needs as its last document's successor, in order, and that block.
    needed = np.empty((0, 2), np.int64)
    if low[0] is not None or low[1]:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
        firsts = _firsts(ids, edges) if len(edges) else {}
        blocks = sorted({*firsts, 0})
        head = -(1 << 63) if low[1] else low[0]
        pairs = [(firsts[b], blocks[k - 1]) for k, b in enumerate(blocks) if k]
        needed = np.array(sorted([*pairs, (head, blocks[-1])]), np.int64)
    shared = spark.sparkContext.broadcast((edges, needed))

    def deal():  # noqa: ANN202
        cuts, (wanted, by) = shared.value[0], shared.value[1].T

        def of(batch: pa.RecordBatch) -> dict:
            ids = ids_of(batch.column("doc_id"))
            at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
            guest = np.flatnonzero(wanted[at] == ids)
            take = pa.array(np.concatenate((np.arange(len(ids)), guest)), pa.int64())
            return {
                "doc_id": batch.column("doc_id").take(take),
                "text": batch.column("text").take(take),
                "block": np.concatenate((block_of(cuts, ids), by[at[guest]])),
                "guest": [False] * len(ids) + [True] * len(guest),
            }

        return of

    def of(t: pa.Table) -> pa.Table:
        ids = ids_of(t.column("doc_id").combine_chunks()).tolist()
        texts, guests = t.column("text").to_pylist(), t.column("guest").to_pylist()
        rows = sorted((i, x) for i, x, g in zip(ids, texts, guests, strict=True) if not g)
        after = min((i, x) for i, x, g in zip(ids, texts, guests, strict=True) if g)
        prints = [fingerprint(x) for _, x in rows]
        last = fingerprint(after[1])
        out: dict[str, list] = {n: [] for n in names}
        for k, (i, text) in enumerate(rows):
            other = rows[k + 1][1] if k + 1 < len(rows) else after[1]
            made = edited(text, other)
            own, new = prints[k], fingerprint(made)
            nxt = prints[k + 1] if k + 1 < len(rows) else last
            for n, v in zip(
                names,
                (
                    None if i == -(1 << 63) else i,
                    len(text),
                    hashlib.sha256(made.encode()).hexdigest(),
                    own,
                    new,
                    likeness(own, new),
                    likeness(own, nxt),
                ),
                strict=True,
            ):
                out[n].append(v)
        return pa.Table.from_pydict(out, schema)

    names = [x.split()[0] for x in _KIND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    dealt = map_batches(base, "doc_id long, text string, block long, guest boolean", deal)
    return dealt.groupBy("block").applyInArrow(of, _KIND)


def _firsts(ids: DataFrame, edges: np.ndarray) -> dict[int, int]:
    """The smallest doc_id of each block that has one."""
    shared = ids.sparkSession.sparkContext.broadcast(edges)

    def least(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = ids_of(b.column(0))
            k = block_of(shared.value, x)
            order = np.lexsort((x, k))
            new = np.diff(k[order], prepend=-1) != 0
            yield pa.RecordBatch.from_pydict({"block": k[order][new], "first": x[order][new]})

    rows = ids.mapInArrow(least, "block long, first long").groupBy("block").agg(F.min("first").alias("f")).collect()
    return {r["block"]: r["f"] for r in rows}


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, fingerprint, distance: the distinct fingerprints of prints within ``radius`` bits of each distinct one of
    queries, itself included. Both have a column fingerprint.

    The bits are cut into radius + 1 blocks, one of which must be equal; there is a table for each, rotated so that
    its block leads and serves as key. No pair is lost; pairs are made only where a key is equal.
    """
    if not 0 <= radius < BITS // 4:
        raise ValueError("radius must be from 0 to 63")
    digits, n = BITS // 4, radius + 1
    cuts = [digits * k // n for k in range(n + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        d = df.select(F.col("fingerprint").alias(name)).where("fingerprint is not null").distinct()
        keys = F.array(
            *[
                F.struct(F.lit(k).alias("t"), F.substring(name, a + 1, b - a).alias("key"))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
            ]
        )
        return d.select(name, F.explode(keys).alias("_k")).select(name, "_k.t", "_k.key")

    pairs = tables(queries, "query").join(tables(prints, "fingerprint"), ["t", "key"]).select("query", "fingerprint")
    parts = [
        F.bit_count(
            F.conv(F.substring("query", at + 1, 8), 16, 10)
            .cast("long")
            .bitwiseXOR(F.conv(F.substring("fingerprint", at + 1, 8), 16, 10).cast("long"))
        )
        for at in range(0, digits, 8)
    ]
    apart = sum(parts[1:], parts[0])
    return pairs.withColumn("distance", apart.cast("int")).where(F.col("distance") <= radius).distinct()
