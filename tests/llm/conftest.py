"""Small document tables with the awkward cases in them."""

import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba ce di fo gu ha ki lo mu ne po ra si tu ve wo ya zi".split()


def word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) or longer rows."""

    def build(rows):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty, blank, repeated and very long texts, and columns named as the
    operators name theirs."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 60) for _ in range(400))
    rows = [
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None),
        (4, "one", "en", None), (5, "one", "en", "b"), (5, "one", "en", "b"), (6, long, "en", "b"),
        (None, "no id here at all, really none", "en", "c"), (7, "1234 5678", "de", "c"),
        (8, "é" * 300, "fr", "c"), (9, "x" * 5000, "fr", "c"),
    ]
    extra = "key string, th string, doc string, n int, score double, row string, copies int, w string, size int"
    schema = T._parse_datatype_string(f"{DOCS}, {extra}")
    full = [(*r, None if r[1] is None else len(r[1]), "k", "t", "d", 1, 0.5, "r", 9, "w", 3) for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture
def no_rows(awkward):
    return awkward.limit(0)
