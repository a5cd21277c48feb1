import random

import pytest

WORDS = "the of river stone walked over seven bridges quiet morning light market old houses sold bread and salt to people from hills".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ly", "ing", str(rng.randint(0, 99))]) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(5)
    base = text(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "Ein Wort zu viel é 日本 🎉 ▁x\x00y"),
            (9, text(rng, 4000)), (10, "ab " * 400), (10, "ab " * 400), (None, text(rng, 60)), (None, base), (11, text(rng, 30) + "\n" + base),
            (12, "All rights reserved.\nReleased under the MIT License.\nCC BY cc-by"), (13, "x" * 500), (14, "<|endoftext|> It's 12 don't"), (15, base + " " + base)]
    rows += [(20 + i, text(rng, rng.randint(1, 90))) for i in range(40)]
    return [(d, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t or "")) for i, (d, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["fp", "node", "key", "words", "row", "doc", "t", "start", "keep", "low", "host", "bucket", "token_ids", "decoded"]


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()
