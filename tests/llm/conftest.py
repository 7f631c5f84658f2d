from __future__ import annotations

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return FOLDER


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, blank, long and repeated texts, ties, and columns named like those of the operators."""
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, " \t\n\x0b\x0c\r ", "fr", "b"), (6, "word", "fr", None),
        (7, "le chat est sur la table et le chien dort. " * 3000, "fr", "a"), (8, "x" * 200_000, None, "a"),
        (9, "漢字 émile \U0001F600 \x00 z", None, "c"), (10, "a@b.co 1.2.3.4 +1 (555) 123-4567", "en", "c"),
        (None, "no key here at all", "en", "c"), (11, "1234 5678", None, "c"), (12, "A. A. A.\nA.\nA.\n", "en", "c"),
    ]
    rows = [(*t, 7, "k", 1.5, True, 3) for t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, "
                                       "kept boolean, size int").repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (7, 0, 1), (99, 1, 0), (12, 0, 1)],
        "doc_id bigint, quality int, toxic int")
