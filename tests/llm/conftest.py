from __future__ import annotations

import pytest

#: Rows every operator must survive: nulls, an empty and a wordless text, repeated rows, ties, a very long text.
LONG = "lorem ipsum dolor sit amet " * 60_000


@pytest.fixture
def odd(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
            (2, None, None, None), (None, "one two three", "en", "b"), (3, "", "de", "a"), (4, " \t\n ", "de", ""),
            (5, "Alpha BETA gamma delta epsilon zeta", "en", "b"), (6, "é è ß 日本 😀", "fr", None), (7, LONG, "en", "a"), (8, "a", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'x' as score", "1 as row", "2 as size", "3 as removed", "4 as token")
