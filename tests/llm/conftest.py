import random

import pytest

# Names that the operators use inside, as further columns of the input.
CLASHING = ["key", "block", "head", "pairs", "bucket", "class", "rank", "offset", "score", "class_id", "root", "pos", "doc",
            "line", "_drop", "_doc", "_removed", "_nth", "bands", "id", "vec", "toxic", "host", "ranked", "n_lines2"]
SF001 = "/root/testdata/sf0.001"


def words(rng, n):
    return [rng.choice(["th", "er", "on", "an", "re"]) + rng.choice(["ea", "ing", "ed", "at", "or", "is"]) + rng.choice(["", "st", "le", "n"])
            for _ in range(n)]


def documents(spark, rows):
    """(doc_id, text) rows as a table with the columns of documents and clashing ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, t, "en", None, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows, ties, missing ids, odd characters."""
    rng = random.Random(5)
    prose = " ".join(words(rng, 300))
    long = "\n".join(" ".join(words(rng, 400)) for _ in range(120))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, prose), (4, prose), (5, prose), (None, prose), (None, None), (6, long), (7, "one"),
            (8, "Žluťoučký kůň <|endoftext|> 日本語 \U0001f600 ́x don't  stop\r\n\x85\xa0\x1c!"), (9, "ǅ İstanbul ẞ ﬁ Ω Å"),
            (10, "!!! ??? ..."), (11, prose + " end")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return documents(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
