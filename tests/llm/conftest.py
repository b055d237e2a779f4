import pytest

COMMON = "The quick brown fox jumps over the lazy dog while the band plays on and on tonight"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    rows = [
        (1, COMMON + ". Released under the MIT License.", "en", "a", 10),
        (2, COMMON + ". Released under the MIT License.", "en", "a", 10),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (5, long, "en", "a", 1),
        (6, long + " tail", None, "b", 1),
        (7, "   \n\t ", "de", None, 2),
        (None, COMMON + " without a number", "en", "c", 3),
        (8, COMMON + " extra words for the end of it", "en", "é", 4),
        (8, COMMON + " extra words for the end of it", "en", "é", 4),
        (9, "a" * 400, "en", "b", 5),
        (10, "xyz " * 100 + "a" * 120, "en", "b", 5),
        (11, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "en", "b", 5),
        (-12, "ünïcödé " * 30, "fr", "a", 5),
        (13, "ünïcödé " * 31 + "😀", "fr", "a", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("size", "score", "shard", "slot", "_key", "key", "copies", "target", "fp")}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
