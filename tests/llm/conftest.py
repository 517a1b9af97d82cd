import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SYLLABLES = "ka lo mi ren tu vas pel dor qui sha ne bor".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with results."""
    long_text = prose(1, 30_000) + " " + "x" * 20_000
    rows = [
        (1, "Hello there, world.", "en", "a", 19, 0.5, "x", True, 1),
        (1, "Hello there, world.", "en", "a", 19, 0.5, "x", True, 1),
        (2, None, "en", "a", 0, None, None, None, None),
        (3, "", None, None, 0, 0.5, "x", True, 1),
        (4, " \t\n ", "fr", "b", 4, 0.5, "x", True, 1),
        (5, "123 456 !!!", "fr", "", 11, 0.5, "x", True, 1),
        (None, "no id at all", "de", "b", 12, 0.5, "x", True, 1),
        (6, long_text, "de", None, len(long_text), 0.5, "x", True, 1),
        (7, "Hello there, world.", None, "b", 19, 0.5, "x", True, 1),
        (8, "naïve café 日本語 😀 <|endoftext|> end", "fr", "c", 30, 0.5, "x", True, 1),
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, "
        "score double, _text string, kept boolean, size int",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 1, 0), (6, 1, 0), (99, 0, 1)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="session")
def no_labels(odd_labels):
    return odd_labels.limit(0)
