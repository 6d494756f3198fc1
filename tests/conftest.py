import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from stockroom.session import get_session
    active = SparkSession.getActiveSession()
    if active is not None:
        active.stop()
    s = get_session("local[4]", shuffle_partitions=8,
                    checkpoint_dir=tempfile.mkdtemp(prefix="stockroom-test-ckpt-"))
    yield s


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="stockroom-test-")
