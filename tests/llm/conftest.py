"""Small tables with the awkward cases every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(6000))


@pytest.fixture
def documents(spark):
    """Rows (id, text, lang, source) as a table shaped like ``documents``."""

    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)

    return make


@pytest.fixture
def awkward():
    """NULLs in any column, empty, very long and equal texts, repeated rows, ids that clash."""
    return [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "b"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (None, "no id here at all", "de", "b"),
        (None, None, None, None),
        (5, "same id", "en", "a"),
        (5, "another text with the same id", "en", "a"),
        (6, LONG, "en", "c"),
        (7, LONG + " end", "en", "c"),
        (8, "   \n\t ", "en", "c"),
        (9, "Ünïcode ñ 🙂 text", "es", None),
    ]


@pytest.fixture
def clashing(documents, awkward):
    """The awkward rows with columns named like those operators use themselves."""
    from pyspark.sql import functions as F

    df = documents(awkward)
    names = ["id", "tid", "t", "h", "row", "size", "key", "copies", "scores", "toxic", "hits", "runs", "spans", "own_id", "a.b"]
    for k, n in enumerate(names):
        df = df.withColumn(n, F.lit(k))
    return df


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))
