import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kpilane.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app_name="kpilane-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def golden(spark):
    from tests.golden import golden_star
    return golden_star(spark)
