import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=5, n=120):
    """Documents with copies, near copies, shared passages and repeated rows."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", *("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(900))]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, out = text(70), []
    for i in range(n):
        kind = i % 6
        if kind == 0 and out:
            t = rnd.choice(out)[1] or ""
        elif kind == 1 and out:
            words = (rnd.choice(out)[1] or "x").split()
            words[rnd.randrange(len(words))] = "edited"
            t = " ".join(words)
        elif kind == 2:
            t = f"{text(30)}\n{passage} {text(20)}"
        else:
            t = text(rnd.choice([3, 12, 60, 200]))
        out.append((i * 3 % 251, t, "en", f"src{i % 4}", len(t)))
    out += [(500, None, "en", "s", 0), (501, "", "de", "s", 0), (502, " \n\t ", None, None, None), (503, "one", "en", "s", 3)]
    out += [(504, "again and " * 300, "en", "s", 3000), (505, "again and " * 300, "en", "s", 3000), (506, "ab" * 1500, "en", "s", 3000)]
    return out


@pytest.fixture(scope="session")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, repeated rows, clashing column names, a long text."""
    rows = [(None, None, None, None, None, "a", 1), (7, "x y " * 40000, "en", "s", 1, "b", 2), (7, "x y " * 40000, "en", "s", 1, "b", 2), (None, "some words here", None, None, None, None, None), (8, "", "en", "s", 0, "", 0), (9, "\x00\x01 　 é", "fr", "s", 5, "", 0)]
    return spark.createDataFrame(rows, SCHEMA + ", bucket string, k1 int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
