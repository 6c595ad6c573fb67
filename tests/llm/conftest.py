"""Documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, kinds string, row int, copies string, n string, key string, size string"


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), None, "mine", 7, "k", 1, "c", "n", "key", "z") for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    long = " ".join(f"w{i % 4000}" for i in range(30000))
    texts = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, long), (8, "Mail a.b@c.example.com, call +1 (017) 555-7713."), (8, "Mail a.b@c.example.com, call +1 (017) 555-7713."), (None, base), (None, "null id"), (9, "ONE TWO")]
    return spark.createDataFrame(rows(texts, lambda i: None if i is None or i == 4 else f"s{i % 3}"), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
