import random

import pytest

WORDS = [a + b for a in ("ta", "re", "lo", "mi", "no", "su", "pe", "ka") for b in ("n", "st", "ra", "lim", "do", "ve", "th", "qu", "x", "ss")]


@pytest.fixture(scope="session")
def prose():
    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """documents from (doc_id, text[, lang]) rows, with columns whose names operators use themselves."""

    def make(rows):
        rows = [(*r, "en")[:3] for r in rows]
        frame = spark.createDataFrame([(i, t, g, "src", len(t or ""), 1, "x", 2.0, [1], 7) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, label string, score double, words array<int>, component long")
        return frame

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, blanks, very long, repeated and tied rows."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (None, "some text of a row that has no id at all"), (4, "one"), (5, "one two"), (6, long), (7, long), (6, long), (8, "é ß 中文 \U0001f600 ́ a"), (9, None, None), (10, "| | |"), (None, None, None)]
