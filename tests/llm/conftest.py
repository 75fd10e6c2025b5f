import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a table of documents: (id, text) rows, with an extra column and one that clashes with results' names."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "1 as n_words", "'x' as component_id", "2 as id") if extra else df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and white texts, ties, repeated rows, a very long word, a very long text."""
    r = random.Random(5)
    long = " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + str(r.randrange(900)) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "null id words here"), (5, "x" * 200_000), (6, long), (7, long), (8, "Ünïcödé ▁ text\x0bwith odd\x0cspaces"), (9, "one"), (-3, "one")]
