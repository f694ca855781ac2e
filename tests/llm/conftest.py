from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labelled_rows():
    """(doc_id, text, quality, toxic) of the middle tables: enough to learn from."""
    import duckdb

    d = "/root/testdata/sf0.1"
    return duckdb.sql(f"SELECT d.doc_id, text, quality, toxic FROM '{d}/documents.parquet' d JOIN '{d}/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()
