import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and blank texts, one word, repeated rows and ids, ties, and a long text."""
    rng = random.Random(3)
    shared = prose(rng, 50)
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3),
        (4, "word", "en", "a", 4), (5, "Word", "de", "b", 4), (6, "été süß 日本", "fr", "b", 10), (7, "12 34 -- !!", "en", "c", 11),
        (None, "no id at all", "en", "a", 12), (8, prose(rng, 30_000), "en", "a", 1),
        (9, f"{prose(rng, 40)} {shared} {prose(rng, 40)}", "en", "b", 1), (10, f"{prose(rng, 10)} {shared}", "de", "c", 1),
        (11, shared, "en", "a", 1), (12, "he he he " * 40, "en", "a", 1),
    ]
    rows += [(13, prose(random.Random(5), 60), "en", "a", 1)] * 3
    rows += [(14, prose(random.Random(5), 60), "de", "a", 1), (14, prose(rng, 60), "de", "a", 1), (15, "A.B.C. don't", "fr", "c", 1)]
    return rows + [(20 + k, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "de", "fr"]), rng.choice("abc"), 1) for k in range(60)]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with more columns, whose names the operators use inside."""
    docs = spark.createDataFrame(messy_rows, DOCS).repartition(5)
    for name in ("fp", "key", "row", "slot", "s", "h", "c", "rid", "content", "score", "start", "ids", "o", "component_id", "rank"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path
