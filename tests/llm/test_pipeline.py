"""The pipeline's stages, each on its predecessor's output."""

from __future__ import annotations

import random
import re

import corpus_pipeline

from tessera.llm import decontaminate, packing
from tessera.llm.common import words_of
from tests.llm.conftest import prose


def test_stages(spark, documents, sf_dir):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        seen[name] = rows
        if name != "packing":
            assert docs.columns == documents.columns
            docs = spark.createDataFrame(rows, documents.schema)
    ids = {n: {r["doc_id"] for r in rows} for n, rows in seen.items()}
    assert ids["near_duplicates"] < ids["language"] and ids["packing"] == ids["pseudonyms"] == ids["decontamination"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    auto = decontaminate.Automaton([(str(r[0]), words_of(r[1])) for r in bench], 10)
    assert not any(auto.matches(words_of(r["text"]))[0] for r in seen["pseudonyms"])
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(seen["packing"])


def test_planted(spark, documents, sf_dir):
    """Copies, benchmark passages and personal data go; clean documents stay as they are."""
    rng = random.Random(3)
    own = [r for r in documents.where("lang = 'en' and n_chars > 1500").orderBy("doc_id").limit(40).collect()]
    words = sorted({w for r in own for w in r["text"].split()})
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()

    def fresh(n):
        return " ".join(rng.choice(words) for _ in range(n))

    clean = [(10_000 + k, fresh(200)) for k in range(20)]
    near = []
    for k in range(5):
        w = clean[k][1].split()
        w[50] = w[120] = "changed"
        near.append((11_000 + k, " ".join(w)))
    exact = [(12_000 + k, clean[k][1]) for k in range(5, 8)]
    leak = [(13_000, f"{fresh(150)} {bench[0]['text']} {fresh(150)}")]
    private = [(14_000, f"{fresh(60)} 4944339490429605 mail a.b@mail1.example.com {fresh(60)}")]
    odd = [(15_000, "12345 !!!"), (15_001, None), (15_002, "")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in [*clean, *near, *exact, *leak, *private, *odd]]
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    got = {r["doc_id"]: r["text"] for r in docs.where("doc_id >= 10000").collect()}
    assert set(got) == {*(i for i, _ in clean), 13_000, 14_000}
    assert all(got[i] == t for i, t in clean)
    assert " ".join(bench[0]["text"].split()[2:8]) not in " ".join(got[13_000].split())
    assert "4944339490429605" not in got[14_000] and "a.b@" not in got[14_000]
    assert re.search(r"\d{16} mail [a-z]\.[a-z]@mail1\.example\.com", got[14_000])
    pieces = packing.pack_documents(docs)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} >= set(got)


def test_empty(spark, documents, sf_dir):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
