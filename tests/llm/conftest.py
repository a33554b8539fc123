from __future__ import annotations

import random

import pytest

CLASHING = ["block", "bucket", "key", "h", "node", "size", "shard", "slot", "words", "score", "held_out", "n_private"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, prose(1, 40_000)),  # very long
    (6, "the same text twice, word for word, in two rows of a table"),
    (6, "the same text twice, word for word, in two rows of a table"),  # a row that repeats
    (7, "the same text twice, word for word, in two rows of a table"),
    (8, "!!! ??? ---"),
    (9, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie"),
    (10, "naïve 中文字符 Привет 😀 \u0000   é"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Odd rows, with columns whose names an operator may use itself."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(i, t, "en" if t else None, None, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in EDGES]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
