import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from quillon.session import local_session

    return local_session(4, spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
