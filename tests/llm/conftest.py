"""Rows that every operator has to bear: nulls, empty texts, repeats, ties and columns with clashing names."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, bands string, word string, run string, _text string, score string, label string"
LONG = "a very long text of many words that goes on and on " * 4000


def rows(texts: list[tuple[int | None, str | None, str | None]]) -> list[tuple]:
    return [(i, t, lang, f"site{k % 5}", None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for k, (i, t, lang) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    texts = [
        (1, "The cat sat on the mat and the dog sat by the door.\nShared line of the site\nend", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, "THE CAT sat on the mat and the dog sat by the door.\nShared line of the site\nend", "en"),
        (4, "THE CAT sat on the mat and the dog sat by the door.\nShared line of the site\nend", "en"),
        (5, "Über ALLE Berge 你好 \U0001f642 <|endoftext|> don't stop", "de"),
        (6, "\n\n \t\r\n", None),
        (None, "no id here", "en"),
        (None, None, None),
        (7, LONG, "en"),
        (8, "123 456 !!! ...", "en"),
        (9, "\x00\x1c control \x85 bytes", "fr"),
    ]
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
