import random

import pytest
from pyspark.sql import functions as F

SPECIAL = [
    (None, "a row without an id that is long enough to be a line of its own"), (9001, None), (9002, ""), (9003, "  \t\n "),
    (9004, "one"), (9005, "The same text twice, with its id. The same text twice, with its id."),
    (9005, "The same text twice, with its id. The same text twice, with its id."), (9006, "x" * 3000), (9007, "é" * 450 + "tail"),
    (9008, "no white space " * 2 + "z" * 500), (9009, "A shared line of some length\nown\n  a SHARED line of some length \n"),
    (9010, "a shared line of some length"), (9011, "A SHARED LINE OF SOME LENGTH\n\n"), (None, "a shared line of some length"),
    (9012, "tabs\tand  spaces\nfold"), (9013, "tabs and spaces fold"), (9014, "tabs  and\r\nspaces fold"),
]


@pytest.fixture(scope="session")
def rows():
    """Generated texts with copies, near copies and shared passages, and the special cases."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuéüñ") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, out = prose(60), list(SPECIAL)
    for i in range(60):
        t = prose(rnd.randint(1, 90))
        if i % 7 == 0:
            t += "\n" + passage + "\n" + prose(5)
        out.append((i, t))
        if i % 5 == 0:  # a copy, and a near copy
            out.append((200 + i, t))
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            out.append((100 + i, " ".join(w)))
    base = prose(80).split(" ")
    for i in range(40):  # a larger group of near copies
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(80)] = rnd.choice(words)
        out.append((300 + i, " ".join(w)))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with other columns whose names clash with those the operators use."""
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(
        ("lang", "k1", "k2", "n", "kept", "score", "key", "size", "spans", "place", "n_kept", "sha", "tag", "regs", "shard", "matches"))])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
