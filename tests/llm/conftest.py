import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, key string, _starts string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'é' * (rng.random() < 0.1)}" for _ in range(n)]


def sample(seed=11):
    """Texts with copies, near copies, shared passages and lines, blanks, nulls and one very long text."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    line = [" ".join(words(rng, 6)) for _ in range(5)]
    texts = []
    for i in range(40):
        w = words(rng, rng.choice([3, 12, 80, 200]), 5000)
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        out = [" ".join(w[a : a + 9]) for a in range(0, len(w), 9)]
        if i % 3 == 0:
            out[len(out) // 2 : len(out) // 2] = line[: rng.choice([2, 3, 5])]
        texts.append("\n".join(out))
    base = words(rng, 120, 5000)
    for _ in range(6):
        near = list(base)
        near[rng.randrange(120)] = "edited"
        texts.append(" ".join(near))
    texts += [texts[1]] * 3 + [None, "", "   \n\t ", "one", "one two three four", "ONE Two three four", "a\x0bb\x0cc\x1cd", "same line\n" * 40]
    texts.append(" ".join(words(rng, 30_000, 10**6)))
    texts.append("x" * 70_000 + " tail")
    return texts


@pytest.fixture(scope="session")
def texts():
    return sample()


@pytest.fixture(scope="session")
def rows(texts):
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 7, "k", "s") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, rows):
    """Rows twice, and rows without doc_id."""
    return frame(spark, rows[:12] + rows[:12] + [(None, rows[0][1]), (None, "nobody knows this text at all here"), (None, None)])
