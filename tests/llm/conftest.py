import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(cases.hard_rows(), cases.SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
