import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with every oddity at once: null, empty, blank, short, long, repeated rows, near copies, shared passages, odd signs."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + ".\n"
    passage, original = prose(120), prose(200)
    texts = [None, "", " \n\t ", "one", "one two three", "ONE two three", prose(3000), original, original, original.upper(), passage + prose(60), prose(80) + passage, passage * 3]
    for i in range(12):
        words = original.split(" ")
        words[10 * i] = f"changed{i}"
        texts.append(" ".join(words))
    texts += [prose(rng.randint(5, 90)) for _ in range(25)]
    texts += ["é" * 900, "a" * 5000, "0" * 3000, "same line\n" * 60, "x <|endoftext|> y", "naïve İstanbul don't stop 　 ½ ﬁ", prose(30) + "\U0001f600 é" * 20]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0, "clash") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "null id", "en", "s", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string").repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
