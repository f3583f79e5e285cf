import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def line(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages."""
    rng = random.Random(11)
    passage = [line(rng, 60), "\n".join(line(rng, 4) for _ in range(4))]
    texts = [None, "", "   \n\t ", "one", "Two words", "É<|endoftext|> naïve\n\n  spaced   out ", "x " * 30_000, line(rng, 20_000), "A" * 5000]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    for i in range(60):
        t = "\n".join(line(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.5:
            cut = t.split("\n")
            cut.insert(rng.randint(0, len(cut)), rng.choice(passage))
            t = "\n".join(cut)
        rows.append((100 + i, t, None, "s", len(t)))
    rows += [rows[20], rows[20], (500, rows[20][1], "fr", "s", 1), (None, rows[21][1], "fr", "s", 1), (None, None, None, None, None), (501, rows[22][1] + " end", "en", "s", 2)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, KINDS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("own") for c in ("score", "predicted", "n_lines", "n_deleted", "fp", "component_id", "n_words", "runs", "items", "row", "part", "rank", "_key", "start", "length", "payload", "chunks")})
