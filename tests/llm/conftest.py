import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents frame from texts or (id, text) pairs."""

    def make(rows, lang="en"):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def prose():
    """Deterministic prose of n words."""

    def make(n, seed, alphabet="abcdefgh"):
        r = random.Random(seed)
        return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))

    return make
