import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from omicframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "omicframe-tests", 4)


@pytest.fixture
def rows():
    def collect(df, *order):
        return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]

    return collect
