import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from corpuskiln.session import local_session, ship

    s = local_session(4, partitions=4, name="tests")
    ship(s)
    yield s
    s.stop()
