import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chainloom.session import local_session
    s = local_session("8", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
