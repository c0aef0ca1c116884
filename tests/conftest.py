import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from zonelens.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, app_name="zonelens-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="zonelens-tests-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from zonelens.plans.bindings import Fixture
    return Fixture(spark, SF_SMALL)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
