import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, rid string, n string, score string, text_a string, h int"


def words(rng, n, size=400):
    return " ".join("".join(chr(97 + (k * 7 + j * 3) % 26) for j in range(1 + k % 5)) + str(k) for k in (rng.randrange(size) for _ in range(n)))


@pytest.fixture(scope="session")
def texts():
    """Texts with every case that the operators define: null, empty, blank, short, long, copies, near copies, shared passages."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split(" ")
    near[60] = "changed"
    lines = "\n".join(words(rng, 6) for _ in range(4))
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "Three Words Here", base, base, " ".join(near), base.upper()]
    out += [words(rng, 30) + " " + passage + " " + words(rng, 30), words(rng, 10) + " " + passage, passage + "\n" + words(rng, 45), words(rng, 30000, 20000)]
    out += [lines + "\n" + words(rng, 5), words(rng, 5) + "\n" + lines, lines + "\n" + lines, "same line\n" * 12, "a " * 700, "é ß İ ﬁ 日本語 😀 don't <|endoftext|> x1 " * 9]
    out += [words(rng, 80) for _ in range(12)]
    return out


def table(spark, texts, first=0):
    rows = [(first + 3 * k, t, ("en", "de", None)[k % 3], "s", len(t or ""), "clash", "clash", "clash", "clash", "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return table(spark, texts).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
