from __future__ import annotations

import pytest

LONG = "alpha beta gamma delta " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    base = " ".join(f"w{k}" for k in range(120))
    near = base.replace("w60 ", "zzz ")
    rows = [
        (1, base, "en", "s1", "x"), (2, near, "en", None, None), (3, None, None, "s1", "x"), (4, "", "en", "s1", "x"), (None, "lonely words of a null id " * 8, "en", "s1", "x"), (5, LONG, "en", "s1", "x"), (6, LONG, "en", "s1", "x"),
        (7, base, "de", "s2", "x"), (7, base, "de", "s2", "x"), (8, "mail ann@x.org, 1.2.3.4 and +1 (555) 555-0100 ext", "en", "s2", "x"), (9, "¡! ?? \U0001f600 \U0001f600 a@b.co", "en", "s2", "x"), (10, "four words are here", "en", "s2", None),
    ]
    names = "doc_id long, text string, lang string, source string, id string, n long, spans string, length int, kept string, rate double, f int, shard int, __x int"
    return spark.createDataFrame([(*r, 1, "s", 2, "k", 0.5, 3, 4, 5) for r in rows], names).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
