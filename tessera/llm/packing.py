"""Vector bin packing of tokenised examples into training sequences."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

LENGTH = 2048
#: An example's end.
END = 1
#: Pieces of one block, which is packed on its own; each block leaves about one sequence partly filled.
BLOCK_PIECES = 4096
SPECIAL = "<|endoftext|>"
#: The role whose words a model learns to write.
LEARNED_ROLE = "assistant"


@functools.lru_cache(4)
def encoder(tokenizer: str, ranks: str | None) -> Callable[[str], list[int]]:
    """text -> ids of the ``tokenizers`` file. With ``ranks``, the same vocabulary and merges as a rank file, texts
    without special tokens take a faster encoder of equal results; what it can't take goes to ``tokenizers``."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)

    def slow(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # noqa: BLE001  its panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens")


def pieces(
    rows: DataFrame,
    keys: list[str],
    learned: Column | None,
    tokenizer: str,
    ranks: str | None,
    length: int = LENGTH,
    max_loss: int = LENGTH,
) -> DataFrame:
    """keys, start, length, ids_crc32, doc_tokens, loss_tokens: the ids of each row's text, with END after them, cut every
    ``length`` ids. Null texts are empty: END alone.

    learned tells whether a row's ids bear loss; those that do are cut every ``max_loss`` ids too. Without it all rows
    bear loss but on each piece's first id, which nothing predicts.
    """
    kind = ", ".join([f"{k} long" for k in keys] + [f"{n} long" for n in _PIECE])
    flag = F.coalesce(learned, F.lit(False)) if learned is not None else F.lit(None).cast("boolean")

    def make():  # noqa: ANN202
        encode = encoder(tokenizer, ranks)

        def of(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in _PIECE}
            row = []
            texts, bears = batch.column("text").to_pylist(), batch.column("_bears").to_pylist()
            for k, (text, bear) in enumerate(zip(texts, bears, strict=True)):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                step = min(length, max_loss) if bear else length
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    loss = len(part) - 1 if bear is None else len(part) if bear else 0
                    for n, v in zip(_PIECE, (at, len(part), zlib.crc32(part.tobytes()), len(ids), loss), strict=True):
                        out[n].append(v)
                    row.append(k)
            take = pa.array(row, pa.int64())
            return out | {k: batch.column(k).take(take) for k in keys}

        return of

    sent = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "text", flag.alias("_bears"))
    return map_batches(sent, kind, make, rows=128)


def pack(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and order within it for each row of sizes, none of which may exceed limits in any dimension.

    One bin is open at a time. It takes, of the items that still fit in every dimension, the one with the largest dot
    product of its demand and what is left, each dimension in shares of its limit and weighted by the mean demand for
    it; ties go to the first item. When nothing fits, the bin is closed.
    """
    n = len(sizes)
    demand = sizes / limits
    weight = demand.mean(axis=0) if n else np.ones(len(limits))
    bins, order = np.empty(n, np.int64), np.empty(n, np.int64)
    alive = np.arange(n)
    now, k = -1, 0
    left = np.zeros(len(limits))
    while len(alive):
        fits = (demand[alive] <= left + 1e-12).all(axis=1) if now >= 0 else np.zeros(len(alive), bool)
        if not fits.any():
            now, k, left = now + 1, 0, np.ones(len(limits))
            fits = np.ones(len(alive), bool)
        worth = np.where(fits, demand[alive] @ (weight * left), -1.0)
        at = int(worth.argmax())
        item = alive[at]
        bins[item], order[item] = now, k
        left = left - demand[item]
        k += 1
        alive = np.delete(alive, at)
    return bins, order


def _placed(cut: DataFrame, keys: list[str], blocks: int, limits: tuple[int, int, int]) -> DataFrame:
    """The pieces with sequence_id and offset: dealt by a hash into blocks, each packed alone."""
    columns = [*keys, *_PIECE]
    dealt = cut.withColumn("_block", F.pmod(F.xxhash64(*keys, "start"), F.lit(blocks)))
    names = [*columns[:-1], "sequence_id", "offset", "loss_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def of(t: pa.Table) -> pa.Table:
        # Whole numbers stay Arrow's, in which those beside a null keep all their digits.
        t = t.take(pc.sort_indices(t, [(n, "ascending") for n in (*keys, "start", "ids_crc32")], null_placement="at_start"))
        lengths, loss = t.column("length").to_numpy(), t.column("loss_tokens").to_numpy()
        size = np.stack([lengths, np.ones(len(lengths)), loss], axis=1).astype(float)
        bins, order = np.empty(len(size), np.int64), np.zeros(len(size), np.int64)
        whole = lengths >= limits[0]
        bins[~whole], order[~whole] = pack(size[~whole], np.array(limits, float))
        first = bins[~whole].max() + 1 if (~whole).any() else 0
        bins[whole] = first + np.arange(whole.sum())
        rank = np.lexsort((order, bins))
        before = np.cumsum(lengths[rank]) - lengths[rank]
        starts = np.concatenate(([True], bins[rank][1:] != bins[rank][:-1]))
        offset = np.empty(len(size), np.int64)
        offset[rank] = before - np.maximum.accumulate(np.where(starts, before, 0))
        block = t.column("_block")[0].as_py()
        told = {"sequence_id": pa.array((block << 32) + bins), "offset": pa.array(offset)}
        return pa.table([told.get(n, t.column(n) if n in t.column_names else None) for n in names], schema=schema)

    return dealt.groupBy("_block").applyInArrow(of, ", ".join(f"{n} long" for n in names))


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    length: int = LENGTH,
    max_segments: int = 256,
    max_loss: int = LENGTH,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A sequence holds at most ``length`` ids, ``max_segments`` pieces and ``max_loss`` loss-bearing ids: the first id of
    a piece isn't predicted and bears none. Pieces are dealt by a hash into blocks of about BLOCK_PIECES, each packed
    alone, so no task grows with the input. sequence_id is unique but not gapless: block * 2**32 + bin. Null texts are
    END alone, very long ones are cut; a null doc_id stays null beside any others. An empty table gives an empty result;
    rows that repeat are packed each. Ties go by doc_id, start and checksum. Other columns are ignored.
    """
    if max_loss < length - 1:
        raise ValueError("a whole piece of a document must fit max_loss")
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    cut = pieces(docs, ["doc_id"], None, tokenizer, ranks, length)
    return _placed(cut, ["doc_id"], max(1, -(-docs.count() // BLOCK_PIECES)), (length, max_segments, max_loss))


def pack_turns(
    conversations: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    length: int = LENGTH,
    max_segments: int = 32,
    max_loss: int = LENGTH // 2,
    learned_role: str = LEARNED_ROLE,
) -> DataFrame:
    """conv_id, turn, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens: the turns of conversations
    (conv_id, turn, role, text) as instruction data.

    All ids of a turn by learned_role bear loss, others none; a sequence holds at most ``length`` ids, ``max_segments``
    pieces and ``max_loss`` loss-bearing ids. Each turn is a segment of its own, so a conversation of any length is dealt
    over all tasks. A null role bears no loss; null texts are END alone; an empty table gives an empty result.
    """
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    keys = ["conv_id", "turn"]
    cut = pieces(conversations, keys, F.col("role") == learned_role, tokenizer, ranks, length, max_loss)
    return _placed(cut, keys, max(1, -(-conversations.count() // BLOCK_PIECES)), (length, max_segments, max_loss))
