import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, a shared passage, nulls, blanks, ties and one very long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 50)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 10)}" for _ in range(6)]
    base = prose(rng, 80).split(" ")
    for k in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = f"x{k}"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 20 + ["", "   \t\n", None, None, "one", "one", "two words", "Two WORDS", "é ß ünïcode", prose(rng, 30_000)]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(k, t, f"src{k % 3}" if k % 10 else None, k % 7, "clash") for k, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, id string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
