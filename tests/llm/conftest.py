"""Tables that the tests share."""

import pytest
from pyspark.sql import functions as F

from ..conftest import DATA
from . import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else "fr", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, a null id, and extra columns whose names clash with results."""
    rows = documents(spark, plain.ODD_TEXTS)
    extra = spark.createDataFrame([(None, "word", "en", "s", 4), (3, "word", "en", "s", 4)], DOCS)
    return rows.union(extra).withColumns({c: F.lit(1) for c in ("score", "fp", "spans", "word", "id", "hits", "n_tokens", "held_out", "key", "run")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
