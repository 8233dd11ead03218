import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import local_session

    session = local_session("lodestone-tests", cpus=4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL
