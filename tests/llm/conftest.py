"""Small corpora with planted cases."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n))


def frame(spark, rows, extra: bool = False):
    """Documents of (doc_id, text) or (doc_id, text, source); with extra, columns whose names could clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("node", "root", "h", "id", "pos", "key", "hits", "size", "block", "shard", "host", "rate", "count", "item_id", "words", "parts", "s", "e", "lo", "hi"):
            df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a shared id, and a very long text."""
    long = prose(1, 60_000)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "same words here"),
        (5, "same words here"),
        (5, "same words here"),
        (6, "first text of a shared id"),
        (6, "second text of a shared id"),
        (None, "no id at all"),
        (None, None),
        (7, long),
        (8, "ünïcödé – ©™ 日本語 \u0000 \x1c   end"),
        (9, "x"),
        (10, "| | | | | | | | | | | |"),
        (11, "###$$$%%%^^^&&&***"),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return frame(spark, edge_rows, extra=True)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def nulls_only(spark):
    return spark.createDataFrame([(None, None, None, None, None)] * 2, DOCS)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
