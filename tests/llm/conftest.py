import random

import pytest

WORDS = "the of and to in that with house river stone walk light under open little morning garden window table silver people water".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split())


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, text_hash string, score int, row string, n int, digest int, "
    "found string, term string, pos string, lossless string, `_text` string, held_out string"
)


def table(spark, rows):
    """(doc_id, text) pairs as documents with columns whose names clash with inner ones."""
    full = [(i, t, "en", "src0", None if t is None else len(t), "h", 1, "r", 2, 3, "f", "t", "p", "l", "x", "o") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    base = prose(300, 1)
    return [
        (1, base), (2, base), (3, edited(base, 0.02, 2)), (4, prose(200, 3)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "one two"),
        (10, prose(20000, 4)), (11, "é ▁ 漢字 \x00 😀"), (12, "a"), (None, base), (4, prose(200, 3)), (13, base.upper()),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
