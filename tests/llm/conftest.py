import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the farm today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the farm today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the farm today", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \n\t \n", "fr", "b"),
    (6, LONG, "en", "a"),
    (7, "un deux trois quatre cinq six sept huit neuf dix onze douze\nun deux trois quatre cinq six sept huit neuf dix onze douze", "fr", "c"),
    (8, "mail me at jo.doe@example.com or +1 (555) 123-4567, card 4539578763621486, 10.1.2.3, 1985-03-09", "en", "c"),
    (9, "Released under the MIT License.\nsome more words stand here", "en", "c"),
    (None, "a text without an id stands here all alone", "en", "c"),
    (10, "12345 67890 !!! ???", "en", None),
]


@pytest.fixture(scope="session")
def rough(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the operators' own names."""
    rows = [(*r, 1, "x", "y", 2, 3.0, [1], True) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, n long, score double, words array<int>, row boolean")


@pytest.fixture(scope="session")
def empty(rough):
    return rough.limit(0)
