import random

import pytest

SCHEMA = "doc_id long, text string, n_words string, kept_text string, id string, component_id string, score string, rest string, source string, _row string"


def frame(spark, rows):
    """Documents with columns whose names clash with those of results and intermediate tables."""
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], SCHEMA)


EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "one"),
    (5, "the same line of some words here\n" * 3 + "the end"),
    (6, "  The SAME line of some words here\t\nother"),
    (6, "  The SAME line of some words here\t\nother"),
    (7, "é" * 12 + " ünïcode wörds\n" + "é" * 12),
    (8, "word " * 3000),
    (9, "\n\n\n"),
    (10, "x" * 50_000),
    (None, "the same line of some words here\nand a row without an id"),
    (None, None),
]


def random_docs(n, seed=0, words=60):
    """Documents of few distinct words, some made of parts of others."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) + r.choice(["", "", "\n"]) for _ in range(r.randrange(words)))
        if out and r.random() < 0.5:
            other = r.choice(out)[1].split(" ")
            a = r.randrange(len(other))
            text += " " + " ".join(other[a : a + r.randrange(40)])
        if out and r.random() < 0.1:
            text = r.choice(out)[1]
        out.append((r.randrange(10**6) * 100 + i, text))
    return out


def near_docs(n, seed=0):
    """Families of texts with random edits."""
    r = random.Random(seed)
    out = []
    for family in range(n):
        base = [f"f{family}x{r.randrange(500)}" for _ in range(r.choice([3, 30, 80]))]
        for _ in range(r.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 6])):
                copy[r.randrange(len(copy))] = f"e{r.randrange(1000)}"
            out.append((len(out) * 7 % 1009 + 1009 * len(out), " ".join(copy)))
    return out


empty = pytest.param([], id="empty table")
