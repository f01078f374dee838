import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session("4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from check import SF_DIR, duck

    return duck(SF_DIR)


@pytest.fixture(scope="session")
def shop(spark):
    from check import SF_DIR
    from patronage.sources.shop import Shop

    return Shop(spark, SF_DIR)
