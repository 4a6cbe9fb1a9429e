import pytest

from tests.llm.cases import SCHEMA, documents


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
