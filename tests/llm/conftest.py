import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, maybe boolean, start string, key string, _h int, asked int, s string, doc string"


def rows(texts):
    """(doc_id, text) pairs as rows with columns that clash with what operators use inside."""
    return [(i, t, "en", "src", None if t is None else len(t), "x", True, "y", "k", 7, 1, "z", "d") for i, t in texts]


def corpus(seed=1):
    """Small documents: copies, near copies, shared passages, periodic text, nulls, blanks, ties, a long one, odd letters."""
    r = random.Random(seed)
    vocabulary = ["The", "of", "and", "IN", "été", "straße", "ñandú", "naïve", "x1", "y_2", "don't", "e-mail", *("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(150))]
    make = lambda n: r.choices(vocabulary, k=n)
    passage, texts = make(60), []
    for i in range(24):
        w = make(r.choice([0, 1, 2, 5, 40, 90, 150]))
        if i % 4 == 0:
            at = r.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        texts.append(" ".join(w))
    base = make(120)
    for i in range(8):  # near copies
        w = list(base)
        w[(i * 13) % 120] = f"new{i}"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n", texts[5], texts[6].replace(" ", " \n "), "same words", "same  words", "same\twords ", "lone", "go " * 70, "ab ab ba " * 30, " ".join(make(3000)), "\x00  😀   𝒳", texts[24].upper()]
    order = list(range(len(texts)))
    r.shuffle(order)
    out = [(10 * i, texts[k]) for i, k in enumerate(order)]
    return [*out, out[3]]  # a repeated row


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_id(spark):
    return spark.createDataFrame(rows([(None, "alone here"), (None, None), (4, "alone here"), (None, "other text")]), SCHEMA)
