from __future__ import annotations

import pytest

from framelake import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long and repeated texts, and extra columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id here"), (4, "the same text twice here"), (4, "the same text twice here"), (5, "the same text twice here"),
        (6, LONG), (7, LONG + "end"), (8, "12 34 ++ --"), (9, "Ünïcödé 文字 🙂 text"), (10, "é" * 400), (11, "one"),
    ]
    extra = ("x", 1, 0.5, True, "k", "lang", "src", 3)
    schema = "doc_id long, text string, rest string, rank int, score double, held_out boolean, key string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
