from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, `row` long, part int, term string, d2 double"
LICENSE = "Licensed under the Apache License, Version 2.0."


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, copies and near copies, repeated rows and rows without an id."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, words(2, 9000)), (9, words(3, 40) + "\n" + base[:200]), (10, f"{words(4, 30)}\n{LICENSE}\n{words(5, 30)}"), (11, "Mail é x@y.zz or +1 (555) 010-9999 card 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256"), (7, "one"), (None, base), (None, "alone without an id, " + words(6, 60))]
    rows += [(100 + i, words(100 + i, 60 + i)) for i in range(30)]
    rows += [(200 + i, f"{words(300 + i, 50)}\nThis line is on many sites\n{words(400 + i, 5)}") for i in range(24)]
    return rows


def frame(spark, rows, sources: int = 12):
    data = [(i, t, "ab"[k % 2] if k % 7 else None, f"s{k % sources}" if k % 11 else None, 0, True, "x", 1, 2, "y", 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, texts()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def items(spark):
    rows = [("i1", words(3, 40)), ("i2", "one"), ("i3", None), ("i4", ""), ("i5", words(8, 20)), (None, words(9, 20)), ("i1", words(3, 40))]
    return spark.createDataFrame(rows, "item_id string, text string")
