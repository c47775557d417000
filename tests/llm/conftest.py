"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing column names."""
from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, node string, _key string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(9000))
BASE = " ".join(f"plain{i} word{i * 7 % 101} more" for i in range(40))


def rows(*pairs: tuple[int | None, str | None]) -> list[tuple]:
    return [(i, t, "en", "s", len(t or ""), "clash", "clash", "clash") for i, t in pairs]


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    pairs = [(1, BASE), (2, BASE.upper()), (3, BASE + " one"), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (7, "one two"), (None, "no id here at all"), (None, None), (8, LONG), (9, LONG + " end"), (10, "é ſ K İ ß 　 x")]
    return spark.createDataFrame(rows(*pairs), SCHEMA)


@pytest.fixture(scope="session")
def none(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark) -> DataFrame:
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
