import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "si", "to", "ve") for c in ("l", "m", "n", "")]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words of invented text."""

    def make(n: int, seed: int) -> str:
        draw = random.Random(seed)
        return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def docs(spark):
    """docs(rows, more): a table of doc_id, text and of columns whose names clash with ours."""

    def make(rows, schema="doc_id long, text string"):
        extra = ["score", "statistics", "doc", "runs", "size", "row", "k", "first"]
        wide = [(*r, *([7] * len(extra))) for r in rows]
        return spark.createDataFrame(wide, schema + "".join(f", {x} int" for x in extra))

    return make
