import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, target double, rate double, size long, n_words int, component_id string, rule string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source) with copies, near copies, nulls, empties, repeated rows and a very long text."""
    rng = random.Random(11)
    rows, base = [], words(rng, 120)
    for i in range(30):
        rows.append((i, " ".join(words(rng, rng.randrange(1, 200))), rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + ["b", "a", None])))
    for i in range(30, 45):  # near copies of one text, some of them of the same copy
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(t), "en", "hot"))
    rows += [(45, rows[3][1], "en", "b"), (46, rows[3][1].upper(), "en", "hot"), (47, None, "en", "a"), (48, "", None, None), (49, " \t\n ", "en", "b"), (50, "one two", "en", "b"), (51, "One  two", "de", "a")]
    rows += [(52, " ".join(words(rng, 60_000, 5_000)), "en", "hot"), (53, "tie", "en", "z"), (53, "tie", "en", "z"), (None, "no id at all here now", "en", "a"), (54, "été déjà\nété déjà\n\nété " * 20, "fr", "a")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(*r, 0, True, 0.5, 1.0, 2.0, 3, 4, "x", "y") for r in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
