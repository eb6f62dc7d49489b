import pytest

from llm.helpers import EDGE, SCHEMA, TINY


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")
