import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so", "lu") for b in ("na", "ver", "kol", "dis") for c in ("", "s", "to", "en")]

#: Extra columns whose names clash with those that operators use inside.
EXTRA = ["key", "label", "a", "b", "n", "h", "data", "whole", "first", "nth", "copies", "epochs", "mix_key", "cut_bin", "shard", "rep", "weight", "score", "tokens"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) for _ in range(n)]
    for k in range(12, n, 13):
        out[k] += ".\n"
    return " ".join(out)


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with nulls in every column, empty and very long texts, copies, near copies, repeated rows and extra columns."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 120), "en", "s1", 1),
        (2, prose(2, 120), "en", "s1", 1),
        (2, prose(2, 120), "en", "s1", 1),
        (3, prose(2, 120).replace("tanas", "x"), "fr", None, 1),
        (4, "", "en", "s1", 0),
        (5, "", None, "s2", None),
        (6, None, "en", "s2", None),
        (None, prose(3, 50), "en", "s2", 1),
        (None, prose(3, 50), "en", "s2", 1),
        (None, None, None, None, None),
        (7, long, "de", "s3", len(long)),
        (8, long + " end", "de", "s3", len(long)),
        (9, "one", "de", "s3", 3),
        (10, " \n\t\r\n  ", "de", "s3", 3),
        (11, "ß日本語😀\u0000é" * 40, "de", "s3", 3),
        (12, "x" * 200_000, "de", "s3", 200_000),
        (13, prose(13, 300), "en", "s1", 1),
        (13, prose(14, 300), "en", "s2", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(rows)], schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (7, None, None), (None, 1, 1), (9, 0, 1), (13, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
