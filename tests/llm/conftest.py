from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, key_ long, _h double"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "idiot", "you", "das", "der", "école", "中文", "naïve"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base, long_ = text(120), text(30_000)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),  # a repeated row
        (3, base.replace("alpha", "alpha,", 2), "en", None),
        (4, None, "de", "b"),
        (5, "", None, "b"),
        (6, " \n\t ", "de", "b"),
        (7, long_, "fr", "c"),
        (8, long_[:50_000], "fr", "c"),
        (9, "word", "fr", "b"),
        (9, "another text with the same id", "fr", "b"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (10, "x" * 5000, "en", "c"),
        (11, "line\n" * 60, "en", "c"),
        (12, "12345 !!! ???", "en", "d"),
        (13, "中文 " * 80, "zh", "d"),
    ]
    rows = [(i, t, la, s, None if t is None else len(t), True, "n", 0, 0.5) for i, t, la, s in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
