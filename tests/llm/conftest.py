import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, node int, copies string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    base = "\n".join(line(12) for _ in range(6))
    texts = [None, "", " ", "\n\n", "one", "two words", base, base, base.replace(words[0], "changed"), base + "\n" + line(2), "a  b\t c \n\n d ", "Ünï cödé    <|endoftext|> x", "x" * 5000, base.upper(), " ".join(line(30) for _ in range(60))]
    near = base.split("\n")
    texts += ["\n".join([near[0][:-1] + "q", line(9), near[1][1:]]), line(40), "1234 5678", "漢字 かな", line(3)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), None, "x", 1, "y") for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", "s1", 1, None, None, None), (None, base, "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None), (6, "another text under the same id as before", "en", "s2", 3, "x", 2, "z")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
