"""Registered queries that once did less than their whole job."""

from __future__ import annotations

import os

import numpy as np
import pytest

from tessera.operators import vector
from tessera.queries import QUERIES
from tessera.sources import tables as T


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_ann_topk(spark, sf_dir, sf):
    """With the parameters that ann_topk takes: none but the query."""
    index = vector.InvertedFile(T.star_vectors(spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), sf)))
    rows = index.rows.orderBy("id").select("embedding", "centre").collect()
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    centre, found = np.array([r["centre"] for r in rows]), []
    for i in range(0, len(rows), len(rows) // 40):
        best = np.argsort(-unit @ unit[i], kind="stable")[:10]
        found.append(np.isin(centre[best], index.near(list(rows[i]["embedding"]))).mean())
    assert np.mean(found) >= 0.9


def test_sections_of_all_documents(spark, tmp_path):
    docs = [(1, "one\nthree\nfour five\nx\nseven", "en"), (2, "a\nbb\n\nccc", "es"), (3, "dddd\nee", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, text, lang in docs:
        rows = text.split("\n")
        levels = [len(x) % 6 + 1 for x in rows]
        for n, row in enumerate(rows):
            up = [rows[k] for k in range(n) if levels[k] < levels[n]]
            end = n + 1 if n + 1 < len(rows) else len(rows)
            want.add((f"docs/{lang or 'none'}/{i}.txt", n + 1, levels[n], row[:20], end, up[-1] if up else None))
    got = QUERIES["section_spans"](spark, str(tmp_path))
    assert {tuple(r) for r in got.select("path", "line_start", "level", "name", "line_end", "parent_section").collect()} == want


def test_coordinates_of_the_whole_graph(spark, sf_dir):
    got = {r["id"]: r["spatial"] for r in QUERIES["coordinates"](spark, sf_dir).collect()}
    assert len({r["x"] for r in got.values()}) > 10
    z = {r["id"]: r["z"] for r in QUERIES["importance_z"](spark, sf_dir).collect()}
    assert set(z) == set(got) and all(abs(got[i]["z"] - z[i]) < 1e-9 for i in z)
