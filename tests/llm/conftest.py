import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, digest string"


@pytest.fixture(scope="session")
def prose():
    """A generator of invented words and texts."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(3000)]

    def text(n, seed):
        s = random.Random(seed)
        return " ".join(s.choice(words) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table with further, clashing columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t), "x", None) for i, t in rows], DOCS)

    return make
