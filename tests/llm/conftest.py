import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from samples import ODD, SCHEMA, SF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import get_spark
    s = get_spark("local[*]", 8)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    s.sparkContext.environment["PYTHONPATH"] = root
    yield s


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
