from __future__ import annotations

import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a text without words."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here for once", "en", None, 1), (3, "  \t\n ", "en", "a", 1), (4, long, "en", "b", 1), (4, long, "en", "b", 1), (5, "one two", "de", "a", 1), (6, "!!! ... 123", "en", "a", 1)]
    return spark.createDataFrame(rows, TEXT)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], TEXT)
