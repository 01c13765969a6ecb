import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from freightlens.session import build_session

    s = build_session("local[*]", 8, app_name="freightlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_compare import duck

    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from tests.oracle_compare import duck

    return duck(SF_MID)
