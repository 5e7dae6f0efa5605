import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from factorcast.session import ensure_checkpoint_dir, get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, app="factorcast-tests")
    ensure_checkpoint_dir(s)
    yield s
