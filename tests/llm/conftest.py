import random

import pytest

# extra columns carry names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words string, key string, c0 string, pos string, item_id string"


def sentence(rng, n, vocab=400):
    return " ".join("w%d" % rng.randrange(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    rng = random.Random(11)
    long_text = "\n".join(sentence(rng, 12) for _ in range(2500))
    twice = sentence(rng, 30)
    return [(None, None), (None, "a text without an id of more than ten words is here for all of us"), (None, ""), (1, None),
            (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, twice), (6, twice), (6, twice), (6, sentence(rng, 25)),
            (7, long_text), (8, "Ünï çödé ▁ wörds 日本語 \U0001f600 " + sentence(rng, 20)), (9, "x" * 5000), (10, "\x0b\x0c\r\nA\tB\x00C"),
            (11, "same same same same same same same same same same same same")]


@pytest.fixture()
def edges(spark, edge_rows):
    rows = [(i, t, "en" if i else None, None, len(t or ""), "r", "w", "k", "c", "p", "i") for i, t in edge_rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
