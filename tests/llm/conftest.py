import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, copies int, part string, node string"


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, repeated and null-id documents, with column names that operators use inside."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "vas", "une") for b in ("n", "rd", "st", "la", "po", "q", "x", "ze")]
    prose = [sentence(rng, rng.randint(60, 130), words) for _ in range(30)]
    long = sentence(rng, 30_000, words)
    passage = sentence(rng, 60, words)
    texts = [*prose, None, "", "  \n\t ", prose[0], prose[1], prose[2] + " extra", long, f"{prose[3]} {passage}", f"{passage} {prose[4]}", "été नमस्ते   x y"]
    rows = [(k, t, "en" if k % 2 else "fr", ("a", "b", None)[k % 3], len(t or ""), "s", 1, "p", "n") for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose[6], None, "a", 3, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
