import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Made-up texts with shared passages, near and exact copies, runs, blanks, null and one long text."""
    rng = random.Random(5)
    words = "a b cc dd e' Foo bar! é ß".split()
    pool = [[rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    out = []
    for i in range(120):
        t = []
        for _ in range(rng.randrange(0, 6)):
            t += rng.choice(pool) if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randrange(20))] if rng.random() < 0.5 else ["q"] * rng.randrange(40)
        out.append((i, rng.choice([" ", "\n"]).join(t)))
    base = [rng.choice(words) + str(rng.randrange(500)) for _ in range(120)]
    for i in range(40):  # near copies about the threshold
        t = list(base)
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(len(t))] = f"edit{rng.randrange(9999)}"
        out.append((200 + i, " ".join(t)))
    return [*out, (150, None), (151, ""), (152, "  \n "), (153, " a "), (154, out[3][1]), (155, out[3][1]), (156, "q " * 200), (157, "q " * 100), (158, "x" * 3000), (159, " ".join(map(str, range(9000))))]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With repeated rows and further columns whose names the operators use themselves."""
    rows = [(i, t, "en", None, 1, "w") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
