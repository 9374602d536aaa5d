import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """A small documents table; extra columns have names that operators use themselves."""

    def table(rows, names="doc_id bigint, text string"):
        rows = [(*r, i, "x") for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, names + ", key int, rest string").repartition(3)

    return table


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, repeated rows."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, LONG), (6, LONG), (6, LONG), (None, "no id here"), (7, "Ünï ſK İ\u2003x\x1cy")]
