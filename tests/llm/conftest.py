import pytest

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64, "g", 0),
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64, "g", 0),
    (2, None, "en", None, None, None, 1),
    (3, "", None, "b", 0, None, 2),
    (4, "word", "en", "b", 4, "x", 3),
    (5, "call +1 (375) 555-4393 or 1 (375) 555-4393, mail a.b@mail.example.com", "en", "b", 70, None, 4),
    (6, "x " * 4000 + "Licensed under the Apache License, Version 2.0.", "de", "c", 8047, None, 5),
    (7, "a" * 30000, "fr", None, 30000, None, 6),
    (8, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n mit  license", "en", "c", 9, None, 7),
    (9, "tab\tand   odd space\r\n<|endoftext|> 日本語 ﬁn", "es", "c", 9, None, 8),
    (None, "no id here at all", "en", "a", 17, None, 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, gram string, chunk int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with names that operators use inside."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
