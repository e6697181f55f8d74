"""Tables with every odd case: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", f"w{rng.randint(0, 4000)}", f"v{rng.randint(0, 4000)}"]) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs():
    a, b = prose(1, 160), prose(2, 90)
    near = a.replace("the", "thee", 1)
    rows = [
        (1, a), (2, a), (3, near), (4, b), (5, b + " tail"), (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (10, "one two"),
        (11, prose(3, 9000)), (12, "x" * 5000), (13, a), (13, a), (None, b), (None, None), (14, "Ünï cödé ☃ " * 30),
        (15, prose(4, 60) + " " + a[200:500] + " " + prose(5, 60)), (16, "same line\nsame line\n\nother"), (17, "a \\ b <| c"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None) for k, (i, t) in enumerate(rows)]


@pytest.fixture
def frame(spark):
    """Rows as a table, with columns that clash with names used inside the operators."""
    def make(rows, schema, clash=()):
        df = spark.createDataFrame(rows, schema)
        for name in clash:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
