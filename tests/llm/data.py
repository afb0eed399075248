"""Small tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark string, `group` string, bucket string, key string, tokens string, leaking string, spans string, node string"
REST = ("en", "s", 0, 7, "m", "g", "b", "k", "t", "l", "s", "n")


def prose(r: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def awkward(spark, extra=()):
    """Null ids and texts, empty and blank texts, a repeated row, one id with two texts, a very long text, and columns with names that clash."""
    r = random.Random(5)
    a, b = prose(r, 80), prose(r, 90)
    rows = [(None, a), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, a), (4, a), (5, a), (6, b), (6, prose(r, 70)), (7, prose(r, 60_000, 5000)), (8, "x"), (9, "Ünï çødé 世界"), *extra]
    return spark.createDataFrame([(*x, *REST) for x in rows], SCHEMA)


def table(spark, rows):
    return spark.createDataFrame([(*x, *REST) for x in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
