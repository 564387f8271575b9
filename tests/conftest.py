import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import get_spark
    s = get_spark("local[*]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sales(spark):
    from tarmac.sources.tables import sales_view
    return sales_view(spark, SF_SMALL).persist()
