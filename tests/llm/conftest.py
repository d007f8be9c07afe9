import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, words int, fp int, key string, chunk int, a int, b int, n int"


def row(doc_id, text):
    """A row of documents with extra columns of names that operators use inside."""
    return (doc_id, text, "en", "s", None if text is None else len(text), "x", None, 7, "k", 1, 2, 3, 4)


def texts():
    r = random.Random(5)
    words = "the of and river stone Light été größer niño zebra quick 42 3.14 Foo's don't ÉCOLE".split()
    out = [None, "", " ", "\n\n", "one", "two words", "a b c", "\t x\x0by \x1c z "]
    for k in range(40):
        out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 60))) + ("\n" + " ".join(r.choice(words) for _ in range(9))) * (k % 4))
    out += ["#### !!! $$$ %%% ### &&&", "A " * 300, ("same line here\n" * 30), "x" * 70000, "word " * 20000, "日本語 テキスト です 。", "ends with <|endoftext|> special", "<|endoftext|>"]
    base = " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(200))
    out += [base] * 3 + [base + " tail", "head " + base]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [row(k * 7 - 3, t) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[9], rows[9]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
