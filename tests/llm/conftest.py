import pytest

from inkstrata.llm.common import drop_scratch


@pytest.fixture(autouse=True)
def no_scratch_left(spark):
    yield
    drop_scratch(spark)
