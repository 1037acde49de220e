import hashlib
import random

import pytest

WORDS = "the of and erinat bleor thshwh anble reouon nteaha tion ingther est und der auberein ciónarja éleau que".split()


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randint(0, 999)), "."]) for _ in range(n))


#: Null, empty, white space only, one word, no letters, long, repeated and odd texts; null and repeated ids.
def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    long = prose(rng, 9000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "123 456 !!"), (6, long), (7, long), (7, long), (None, "a text without an id"), (8, "a\x1cb \xa0 c　d"),
            (9, "🙂 漢字 é́ ß İ Σ " * 5), (10, "x" * 3000), (11, "a " * 500)]
    return rows + [(i, prose(rng, rng.randint(1, 60))) for i in range(20, 60)]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case and columns whose names clash with those the operators use inside."""
    rows = [(i, t, "en", "s", 0, 0, "x", 1.0) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, segment string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
