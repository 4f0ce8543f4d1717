from __future__ import annotations

import pytest

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, non-ASCII, special strings.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (3, None),
    (4, ""),
    (5, " \t\n\r\x0b\x0c "),
    (6, "one"),
    (6, "one"),
    (None, "a row without an id"),
    (7, "Écoutez  ça, naïve — 漢字かな交じり文 ՘ \U0001f600 don't we'll <|endoftext|> done<|endoftext|>"),
    (8, "word " * 30_000),
    (9, "mail jane.doe+x@mail.example.org, 10.0.0.255 or 999.1.1.1 card 4111 1111 1111 1111 tel +1 (555) 123-4567"),
    (10, "A" * 70_000),
]


def rows(texts=TEXTS):
    """With columns that clash with names the operators use themselves."""
    return [(i, t, "en", ("s1", "s2", None)[k % 3], len(t or ""), 1, "x") for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string"


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
