from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """documents of (doc_id, text, lang, source), in two partitions."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(2)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and blank texts, repeated rows, a long text, odd characters."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "über"]) for _ in range(30_000))
    texts = [None, "", " \t\n", "one", "two words", long, long, "tab\tand\x0bvertical \x1c unit", "émoji 🙂 text\nline\nline\n", "a" * 5000, "x\u00a0y"]
    rows = [(k, t, "en" if k % 2 else None, ["a", None, "b"][k % 3]) for k, t in enumerate(texts)]
    return [*rows, (None, "no id here at all", None, None), rows[4], rows[4]]


WORDS = "time stone river light house garden winter morning paper window table forest silver market letter mountain bridge summer".split()


@pytest.fixture(scope="session")
def prose():
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    return make
