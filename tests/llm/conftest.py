"""Awkward documents: nulls, empty and long texts, ties, repeated rows, columns whose names clash with those used inside."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key1 string, id string, t int, node int, length string, kept string"


def some_words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def awkward_texts() -> list[str | None]:
    rng = random.Random(5)
    base = [some_words(rng, rng.randint(40, 160)) for _ in range(12)]
    out: list[str | None] = [None, "", " \t\n", "one", "One", "ß 日本 😀 é\x00 ▁", "a" * 700, "ab " * 500, base[0], base[0] + " ", base[0].upper(), base[0].replace(" ", "\n")]
    out += base + [b + " " + some_words(rng, 3) for b in base[:6]] + [base[3][: len(base[3]) // 2] + " " + base[4], base[5] + " " + base[6], some_words(rng, 9000)]
    words = base[7].split()
    for i in range(8):  # near copies
        w = list(words)
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    return out + [base[8]] * 5 + ["!!! ???", "x y z", "x y z w", "x y z w v", "x y z w v u"]


@pytest.fixture(scope="session")
def texts():
    return awkward_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3 % 101, t, "en", "s", 0, "k", "i", 1, 2, "l", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def twice(spark, docs):
    """With rows that repeat an id and a text, and rows without an id."""
    from pyspark.sql import functions as F

    return docs.unionByName(docs.filter("doc_id < 12")).unionByName(docs.filter("doc_id between 20 and 30").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
