import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, i long, fp long, node string, first string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with those used inside."""

    def of(rows):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, 2, 3, "n", "f") for i, t, lang in rows], SCHEMA)

    return of


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty and blank texts, one word, a very long text, ties and repeated rows."""
    long = " ".join(words(7, 30_000))
    same = "\n".join(" ".join(words(k, 12)) for k in range(8))
    return [(None, "no id here", "en"), (1, None, "en"), (None, None, None), (2, "", "en"), (3, "   \n\t ", None), (4, "word", "en"), (5, long, "en"), (6, same, "en"), (7, same, "de"), (7, same, "de"), (8, same.upper(), None), (9, "a a a a a " * 200, "en")]
