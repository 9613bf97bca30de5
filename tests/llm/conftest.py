import pytest
from llm_cases import ODD, frame


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()
