"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, hot_join, lean, map_batches

DIMENSIONS = 1024
SEED = 20240229
#: Training documents of a language, at most; chosen by a hash of doc_id. The only bounded sample here.
SAMPLE = 2000
UNKNOWN = "und"
#: Share of what texts of the learned languages score, under which a text is in none of them.
FLOOR = 0.5
#: Trigrams whose vectors are multiplied at once, which bounds the matrices.
PART = 2048
# Python's word characters but digits; some of them, such as superscripts and fractions, aren't letters.
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str | None) -> str:
    """The runs of letters of a text in lower case, with single blanks between."""
    words = _WORDS.findall(text or "")
    flat = "".join(words)
    return " ".join(words if not flat or flat.isalpha() else _LETTERS.findall(" ".join(words))).lower()


@functools.lru_cache(100_000)
def letter(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a character."""
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


class Grams:
    """Vectors of letter trigrams: the product of the letters' vectors, rotated by 2, 1 and 0 places."""

    def __init__(self, most: int = 20_000) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.empty((most, DIMENSIONS), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The codes' vectors; those made before are kept while there is room."""
        if len(self.row) + len(codes) > len(self.vectors):
            self.row = {}
        for c in codes.tolist():
            if c not in self.row:
                a, b, last = c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF
                self.vectors[len(self.row)] = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(last)
                self.row[c] = len(self.row)
        return self.vectors[np.fromiter(map(self.row.__getitem__, codes.tolist()), np.int64, len(codes))].astype(np.float32)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The sum of the trigram vectors of each text's lower-case letters, words between single blanks; zeros for a
        text without letters."""
        found, counts = [], []
        for text in texts:
            flat = letters(text)
            if not flat:
                found.append(np.empty(0, np.int64))
                counts.append(np.empty(0, np.int64))
                continue
            c = np.frombuffer(f" {flat} ".encode("utf-32-le"), np.uint32).astype(np.int64)
            u, n = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
            found.append(u)
            counts.append(n)
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        all_codes = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        if not len(all_codes):
            return out
        for at in range(0, len(all_codes), PART):
            part = all_codes[at : at + PART]
            table = np.zeros((len(texts), len(part)), np.float32)
            for k, (u, n) in enumerate(zip(found, counts, strict=True)):
                if len(u):
                    where = np.minimum(np.searchsorted(part, u), len(part) - 1)
                    here = part[where] == u
                    table[k, where[here]] = n[here]
            out += table @ self.rows(part)
        return out


@functools.lru_cache(1)
def _grams() -> Grams:
    return Grams()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _sample(docs: DataFrame, sample: int) -> DataFrame:
    """lang, text of at most about ``sample`` documents of each language, none of them held out, chosen by a hash."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    )
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("_n")))
    rows = counts.agg(F.sum("_n"), F.sum(F.least("_n", F.lit(sample)))).first()
    shares = counts.withColumn("_share", F.least(F.lit(1.0), sample / F.col("_n")))
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    chosen = hot_join(known.withColumn("_part", part), shares, "lang", "_n", rows[0] or 0).where("_part < _share")
    # Dealt evenly, not by a key, so copies of one text don't meet in a task.
    return chosen.select("lang", "text").repartition(max(1, min(64, (rows[1] or 0) // 1000)))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A prototype for each language: the normalised sum of normalised document vectors, from at most about ``sample``
    documents of it, none of them held out. Rows with null lang or text teach nothing. The driver holds 8 kB for each
    value of lang."""
    lean(docs.sparkSession)

    def sums(batches):  # noqa: ANN001, ANN202
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = batch.slice(at, 256)
                v = _grams().bundle(x.column("text").to_pylist()).astype(np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(norm > 0, norm, 1)
                langs = np.array(x.column("lang").to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + v[langs == lang].sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"lang": list(total), "v": [x.tolist() for x in total.values()]},
            schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]),
        )

    out: dict[str, np.ndarray] = {}
    for r in sorted(_sample(docs, sample).mapInArrow(sums, "lang string, v array<double>").collect(), key=lambda r: (r["lang"], r["v"])):
        out[r["lang"]] = out.get(r["lang"], 0) + np.array(r["v"])
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def _scorer(prototypes: dict[str, np.ndarray]):  # noqa: ANN202
    """texts -> languages, cosines with the nearest prototype, and letters of each text."""
    langs = [*prototypes]
    protos = np.array([prototypes[n] for n in langs], np.float32).reshape(len(langs), DIMENSIONS)

    def score(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        v = _grams().bundle(texts)
        norm = np.linalg.norm(v, axis=1)
        size = np.array([len(letters(t)) for t in texts], np.int64)
        if not langs:
            return [UNKNOWN] * len(v), np.zeros(len(v)), size
        cos = v @ protos.T / np.where(norm > 0, norm, 1)[:, None]
        best = cos.argmax(axis=1)
        sure = np.where(norm > 0, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).astype(float)
        return [UNKNOWN if n == 0 else langs[b] for b, n in zip(best, norm, strict=True)], sure, size

    return score


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    score is the cosine with the nearest prototype, 0 at least. Null texts, texts without a letter, and all texts if
    nothing was learned are ``und`` with score 0. Very long texts are read whole. Ties go to the first language in
    alphabetical order. lang, source and doc_id take no part in the prediction; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    sent = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = T.StructType(
        [sent.schema["doc_id"], sent.schema["held_out"], *T._parse_datatype_string("lang_pred string, score double")]
    )

    def make():  # noqa: ANN202
        score = _scorer(shared.value)

        def of(batch: pa.RecordBatch) -> dict:
            lang, sure, _ = score(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": sure.tolist()}

        return of

    return map_batches(sent, kind, make)


def floors(docs: DataFrame, prototypes: dict[str, np.ndarray], sample: int = SAMPLE) -> np.ndarray:
    """The least score of a text of a learned language, by the number of its letters' binary digits: FLOOR of the score
    that all but a thousandth of the sampled texts of that length reach. Classes with under 50 texts take the floor of
    the next shorter class that has them; shorter texts than those have none. Documents are full of names and numbers, so
    the floor lies well under what clean ones reach."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    def scored(batches):  # noqa: ANN001, ANN202
        score = _scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                _, sure, size = score(batch.column("text").slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_pydict({"k": _size_class(size), "score": sure})

    told = _sample(docs, sample).select("text").mapInArrow(scored, "k long, score double").where("k > 0")
    rows = told.groupBy("k").agg(F.percentile_approx("score", 0.001, 10_000).alias("s"), F.count("*").alias("n")).collect()
    out = np.zeros(64)
    for r in rows:
        if r["n"] >= 50:
            out[r["k"]] = FLOOR * r["s"]
    return np.maximum.accumulate(out)


def _size_class(letters_: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(letters_, 0) + 1)).astype(np.int64)


def known(docs: DataFrame, prototypes: dict[str, np.ndarray], floor: np.ndarray) -> DataFrame:
    """docs, all columns, without the rows whose text has no letter or scores under the floor of its length."""
    shared = docs.sparkSession.sparkContext.broadcast((prototypes, floor))

    def make():  # noqa: ANN202
        score = _scorer(shared.value[0])

        def of(batch: pa.RecordBatch) -> dict:
            lang, sure, size = score(batch.column("text").to_pylist())
            good = (np.array(lang, object) != UNKNOWN) & (sure >= shared.value[1][_size_class(size)])
            keep = pa.array(good.astype(bool))
            return {n: batch.column(n).filter(keep) for n in batch.schema.names}

        return of

    return map_batches(docs, docs.schema, make)


def accuracy(pred: DataFrame, docs: DataFrame) -> pd.DataFrame:
    """Held-out accuracy by language."""
    joined = pred.where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    return joined.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy")).toPandas()
