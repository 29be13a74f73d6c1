import random

import pytest

LONG = 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, row string, bits double, size long, item_id long"


def make_docs(seed=1, n=60):
    """Small documents with every odd case: nulls, blanks, copies, near copies, shared passages, ties, a very long text."""
    rng = random.Random(seed)
    syllables = "ta re mo li ku sen dor vi pa ne gro ti".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(45)
    docs = [(i, text(rng.randint(1, 160)) + rng.choice(["", ".\n", "\t x", "\n\n"]), "en" if i % 3 else "de", f"s{i % 4}") for i in range(n)]
    docs += [(100 + i, f"{text(20)} {passage} {text(15)}", "en", "s0") for i in range(5)]
    base = text(200).split()
    for i in range(6):  # near copies: one word changed
        w = list(base)
        w[30 * i] = "changed"
        docs.append((200 + i, " ".join(w), "en", "s1"))
    docs += [(300 + i, docs[3][1], "en", None) for i in range(7)]  # exact copies
    docs += [(400, None, "en", "s2"), (401, "", None, "s2"), (402, "  \n\t ", "fr", "s9"), (403, "one two", "en", "s3"), (404, "é ñ “q” 日本語 テスト 🙂 naïve", "xx", "s3"), (None, "no id here at all but five words", None, None)]
    docs += [(405, "la la la la la la la la la la " * 8, "en", "s3"), (406, "Repeat me.\nRepeat me.\nRepeat me.\n", "en", "s3"), (407, text(LONG), "en", "s0"), (5, docs[5][1], "en", "s1"), (5, docs[5][1], "en", "s1")]
    docs += [(408, "Licensed under the Apache License, Version 2.0. MIT License mit license", "en", "s2"), (409, "AbC###$$ <b> | & ** " + text(60), "en", "s2"), (410, "a\x00b\x1cc \x85 x y z " + text(60), "en", "s2")]
    docs += [(411, "x" * 5000 + " " + text(40), "en", "s2"), (412, "<|endoftext|> is text " + text(8), "en", "s2")]
    return docs


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, None, 1, "r", 0.5, 2, 3) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
