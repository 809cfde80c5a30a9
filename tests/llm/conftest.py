import pytest


@pytest.fixture(scope="session", autouse=True)
def _shared(spark):
    yield spark
