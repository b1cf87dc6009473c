import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskwave.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app_name="riskwave-tests")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from riskwave.oracle_check import duck
    return duck(SF_SMALL)
