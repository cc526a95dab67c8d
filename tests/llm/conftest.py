import random

import pytest

WORDS = "the of and that thing ernest other hash lost order inner early text shown found reader other's café naïve straße".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "s"]) for _ in range(n))


def documents(seed=0, n=60):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randrange(1, 120)), "en", f"src{i % 3}", None) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, "", None, "src0", 0), (n + 3, " \n\t ", "en", "src0", 4)]
    rows += [(n + 10 + k, rows[3][1], "en", "src0", None) for k in range(7)]  # copies
    rows += [(None, rows[4][1], "en", "src1", None), (None, "no id here", "en", "src1", 3), (5, rows[5][1], "en", "src2", None)]  # no id, a repeated row
    rows += [(n + 30, "long " * 20_000 + "end", "en", "src0", None), (n + 31, "x" * 30_000, "en", "src0", None)]
    return [(i, t, a, b, len(t or "") if c is None else c) for i, t, a, b, c in rows]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
