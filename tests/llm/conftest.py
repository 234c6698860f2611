from __future__ import annotations

import pytest

from corpus_fixture import SCHEMA, messy_rows
from quotelens.llm.common import staging


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def stage(spark):
    with staging(spark) as found:
        yield found
