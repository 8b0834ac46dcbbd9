"""Small tables with the awkward rows that every operator must take."""

import random

WORDS = [a + b for a in "ba ke mi lo su ta ri no de fa".split() for b in "ra len mo tis gu".split()]


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward(spark, rows=()):
    """documents with nulls, empty and blank texts, a long text, repeated rows and extra columns with clashing names."""
    base = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "Ünïcode ≠ ASCII \U0001f600 ok"), (905, prose(5, 4000)), (906, prose(6)), (906, prose(6)), (907, prose(6)), (908, "x" * 3000)]
    data = [(i, t, "en", "s", None, "a", 1, "k", 2.0, "b") for i, t in [*rows, *base]]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, key int, t string, score double, block string")


def empty(spark):
    return awkward(spark).where("doc_id < 0")
