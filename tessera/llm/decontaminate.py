"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import FOLD, cut, hot_join, map_batches, thin, union, words_of

#: About so many words of items are in one automaton, some 60 MB of each worker. More items make more automata, which are
#: held one at a time.
BLOCK_WORDS = 100_000


class _Ids(dict):
    def __missing__(self, key: bytes) -> int:
        return -1


class Automaton:
    """Suffix automaton of several word sequences. ``window`` consecutive words of an item are a window; an item of
    fewer words is one window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, _Ids()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: dict[int, set[str]] = {}  # of the state that holds a window
        self.short: dict[int, list[tuple[int, str]]] = {}  # items shorter than a window, by the state that holds them
        self.least = window
        coded = []
        for name, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((name, ids))
                self.least = min(self.least, len(ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        pairs = {a * (len(self.vocab) + 1) + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        for name, ids in coded:
            for _, state, length in self.walk(ids):
                if len(ids) < window:
                    if length == len(ids):
                        self.short.setdefault(state, []).append((length, name))
                elif length >= window:
                    self.items.setdefault(self._shrink(state), set()).add(name)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _shrink(self, state: int) -> int:
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, ids: Iterable[int]) -> Iterable[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each position."""
        state = length = 0
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield i, state, length

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged word spans under occurring windows, the items with occurring windows, and the longest match seen.

        Only runs of words whose neighbouring pairs all occur in items are walked: a match can't leave such a run.
        """
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        ids = np.fromiter(map(self.vocab.__getitem__, words), np.int64, len(words))
        if self.least <= 1:
            runs = [(0, len(ids))] if len(ids) else []
        else:
            known = ids >= 0
            at = np.flatnonzero(known[:-1] & known[1:])
            if not len(at) or not len(self.pairs):
                return spans, found, longest
            code = ids[at] * (len(self.vocab) + 1) + ids[at + 1]
            k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            at = at[self.pairs[k] == code]
            if len(at) < self.least - 1:
                return spans, found, longest
            breaks = np.flatnonzero(np.diff(at) != 1)
            first = np.concatenate(([0], breaks + 1))
            end = np.concatenate((breaks, [len(at) - 1]))
            long = end - first + 2 >= self.least
            runs = [(int(at[a]), int(at[b]) + 2) for a, b in zip(first[long], end[long], strict=True)]

        def add(a: int, b: int) -> None:
            while spans and a <= spans[-1][1]:
                a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                spans.pop()
            spans.append((a, b))

        for lo, hi in runs:
            for i, state, length in self.walk(ids[lo:hi].tolist()):
                longest = max(longest, length)
                end = lo + i + 1
                if length >= self.window:
                    found |= self.items.get(self._shrink(state), set())
                    add(end - self.window, end)
                if self.short:
                    up = state
                    while up > 0:
                        for n, name in self.short.get(up, ()):
                            if n <= length:
                                found.add(name)
                                add(end - n, end)
                        up = self.link[up]
        return spans, found, longest


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text with the words in the spans taken out, with what stands between them; a line break is left instead."""
    raw = text.encode("utf-8", "replace")
    folded, ends, at = raw.translate(FOLD), [], 0
    bounds = []
    for w in folded.split():
        at = folded.index(w, at)
        bounds.append((at, at := at + len(w)))
    last = 0
    for a, b in spans:
        ends.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"\n".join([*ends, raw[last:]]).decode()


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // (6 * block_words)))


def automaton(benchmark: DataFrame, window: int, block: int, blocks: int) -> Broadcast:
    """The broadcast automaton of one block of items, dealt by a hash."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where(
        "t is not null"
    )
    part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block)
    return benchmark.sparkSession.sparkContext.broadcast(
        Automaton(((r["item"], words_of(r["t"])) for r in part.collect()), window)
    )


_FOUND = "n_words long, spans array<struct<lo:long,hi:long>>, items array<string>, longest long"


def _searched(texts: DataFrame, keys: list[str], built: Broadcast) -> DataFrame:
    """keys, n_words, spans, items, longest of each row's text, by one automaton."""
    kind = T.StructType([*[texts.schema[k] for k in keys], *T._parse_datatype_string(_FOUND)])

    def make():  # noqa: ANN202
        auto = built.value

        def of(batch: pa.RecordBatch) -> dict:
            n, spans, items, longest = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                s, i, most = auto.matches(words)
                n.append(len(words))
                spans.append([{"lo": a, "hi": b} for a, b in s])
                items.append(sorted(i))
                longest.append(most)
            found = {"n_words": n, "spans": spans, "items": items, "longest": longest}
            return found | {k: batch.column(k) for k in keys}

        return of

    return map_batches(texts.select(*keys, "text"), kind, make)


def _text_key() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _hits(texts: DataFrame, benchmark: DataFrame, window: int, blocks: int) -> DataFrame:
    """key, spans, items, longest of the texts (key, text) in which any block's items stand; each key once. One block's
    automaton is held at a time."""
    parts = []
    for k in range(blocks):
        built = automaton(benchmark, window, k, blocks)
        parts.append(cut(_searched(texts, ["key"], built).where("longest > 0").dropDuplicates(["key"]).drop("n_words")))
        built.destroy()
    told = union(parts).groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )

    def make():  # noqa: ANN202
        def of(batch: pa.RecordBatch) -> dict:
            spans = [merged([(x["lo"], x["hi"]) for x in s]) for s in batch.column("spans").to_pylist()]
            return {n: batch.column(n) for n in ("key", "items", "longest")} | {
                "spans": [[{"lo": a, "hi": b} for a, b in s] for s in spans]
            }

        return of

    return map_batches(told, told.schema, make)


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans, items, longest of each row.

    Items are read in blocks of about ``block_words`` words, so neither the driver nor a broadcast grows with the
    benchmark. With one block the documents stream through its automaton, without any shuffle; with several they do so
    for each block, and what the blocks find in a text is joined to its rows. The result is the same.
    Null or empty texts have no words, very long ones are searched whole. Items without words match nothing; item ids
    that repeat count once.
    """
    blocks = blocks_of(benchmark, block_words)
    base = docs.select("doc_id", "text")
    if blocks == 1:
        return _searched(base, ["doc_id"], automaton(benchmark, window, 0, 1))
    keyed = base.withColumn("key", _text_key())
    found = cut(_hits(keyed.where("text is not null").select("key", "text"), benchmark, window, blocks))

    def make():  # noqa: ANN202
        return lambda b: {
            "doc_id": b.column("doc_id"),
            "key": b.column("key"),
            "n_words": [len(words_of(t)) for t in b.column("text").to_pylist()],
        }

    kind = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("key binary, n_words long")])
    counted = cut(map_batches(keyed, kind, make))
    hit = _to_rows(thin(counted, found.select("key"), "key", "left_semi"), found)
    rest = thin(counted, found.select("key"), "key", "left_anti").select(
        "doc_id",
        "n_words",
        F.expr("cast(array() as array<struct<lo:long,hi:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.lit(0).cast("long").alias("longest"),
    )
    return hit.select(rest.columns).unionByName(rest)


def _to_rows(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """rows joined to keyed by key, of which a text's many copies may have the same."""
    rows = cut(rows)
    weights = rows.groupBy("key").agg(F.count("*").alias("_n"))
    return hot_join(rows, cut(keyed.join(weights, "key")), "key", "_n", rows.count())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest; a row for each row of docs, see match()."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.hi - s.lo)")
    return match(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs, all columns, without the spans that match items over ``window`` words (or whole shorter items); documents
    with more than ``max_coverage`` of their words in such spans go. n_chars, if there and a whole number, follows the
    text.

    Coverage is that of the whole text by all items. Cutting is repeated until no item matches, whatever the number of
    blocks that the items are read in. Null and empty texts stay as they are; copies of a text are treated alike.
    """
    blocks = blocks_of(benchmark, block_words)
    if blocks == 1:
        return _without_items(docs, automaton(benchmark, window, 0, 1), max_coverage)
    names = docs.columns
    keyed = docs.withColumn("__key", _text_key())
    texts = keyed.where("text is not null").select(F.col("__key").alias("key"), "text")
    found = cut(_hits(texts, benchmark, window, blocks).where(F.size("spans") > 0).select("key", "spans"))
    ids = found.select(F.col("key").alias("__key"))
    own = cut(thin(texts, found.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    made = cut(_cut_once(own.join(found, "key"), max_coverage))
    done, now = [made.where("text is null")], made.where("text is not null")
    while not now.isEmpty():
        left = now.select(F.col("key").alias("first"), "text").withColumn("key", _text_key())
        again = cut(_hits(left.select("key", "text"), benchmark, window, blocks).where(F.size("spans") > 0).select("key", "spans"))
        done.append(left.join(again, "key", "left_anti").select(F.col("first").alias("key"), "text"))
        more = left.join(again, "key").select(F.col("first").alias("key"), "text", "spans")
        now = cut(_cut_once(more, 1.0))
    told = cut(union([d.select("key", F.col("text").alias("__text")) for d in done]))
    rows = thin(keyed, ids, "__key", "left_semi").withColumnRenamed("__key", "key")
    changed = _to_rows(rows, told).where("__text is not null").withColumn("text", F.col("__text"))
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    kept = thin(keyed, ids, "__key", "left_anti").select(names)
    return kept.unionByName(changed.select(names))


def _cut_once(rows: DataFrame, max_coverage: float) -> DataFrame:
    """key, text without its spans; null for those with more than max_coverage of their words in spans."""

    def make():  # noqa: ANN202
        def of(batch: pa.RecordBatch) -> dict:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                pairs = [(s["lo"], s["hi"]) for s in spans]
                share = max_coverage * len(words_of(text))
                out.append(None if sum(b - a for a, b in pairs) > share else without(text, pairs))
            return {"key": batch.column("key"), "text": out}

        return of

    return map_batches(rows.select("key", "text", "spans"), "key binary, text string", make)


def _without_items(docs: DataFrame, built: Broadcast, max_coverage: float) -> DataFrame:
    def make():  # noqa: ANN202
        auto = built.value

        def of(batch: pa.RecordBatch) -> dict:
            old = batch.column("text").to_pylist()
            texts, keep = list(old), []
            for k, text in enumerate(old):
                words = words_of(text)
                spans = auto.matches(words)[0]
                keep.append(sum(b - a for a, b in spans) <= max_coverage * len(words))
                while spans and keep[-1]:
                    text = without(text, spans)
                    spans = auto.matches(words_of(text))[0]
                texts[k] = text
            out = {n: batch.column(n) for n in batch.schema.names}
            out["text"] = pa.array(texts, pa.string())
            if "n_chars" in out and pa.types.is_integer(out["n_chars"].type):
                n_chars = zip(out["n_chars"].to_pylist(), old, texts, strict=True)
                out["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in n_chars], out["n_chars"].type)
            mask = pa.array(keep, pa.bool_())
            return {n: x.filter(mask) for n, x in out.items()}

        return of

    return map_batches(docs, docs.schema, make)
