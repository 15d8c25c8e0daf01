import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use themselves.
CLASHES = ["_id", "_th", "_nth", "_letter", "letter", "_kept", "kept", "score", "lang_pred", "copies", "_pos", "_lines", "row", "fp", "root", "size", "target", "h", "h1", "label"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, note string, length long"


def words(rng, n):
    return " ".join(rng.choice(["the", "Of", "ant", "ión", "und", "sol,", "mar.", "a1"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    base = words(rng, 300)
    rows = [
        (1, None, None, None, None, "x", 1),
        (2, "", "en", "a", 0, None, None),
        (3, " \n\t\r\x0b\x0c ", "en", "a", 6, "x", 2),
        (4, base, "en", "a", 9, "x", 2),
        (5, base, "en", None, 9, "x", 2),
        (6, base.upper(), "fr", "b", 9, "x", 2),
        (7, "one", "fr", "b", 3, "x", 2),
        (7, "one", "fr", "b", 3, "x", 2),
        (8, words(rng, 60_000), "de", "b", 1, "x", 2),
        (None, "no id here at all", "de", "b", 1, "x", 2),
        (9, "a  b\n\n\tc \x1c d e 　f<|endoftext|>'ll I'm 12 ½", None, "b", 1, "x", 2),
        (10, "\n".join(["Shared Line"] * 3 + ["x"]), "en", "c", 1, "x", 2),
        *[(20 + i, f"  shared line\t\n{words(rng, 50)}\n\nEnd {i % 3}", "en", "c", 1, "x", 2) for i in range(15)],
        *[(100 + i, words(rng, rng.randrange(1, 700)), "en", "s%d" % (i % 3), 1, "x", 2) for i in range(60)],
    ]
    return clashing(spark.createDataFrame(rows, DOCS))


def clashing(docs):
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) if i % 2 else F.struct(F.col("doc_id").alias("x")) for i, c in enumerate(CLASHES)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], DOCS))
