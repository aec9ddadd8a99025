import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from roilens.session import local_session

    s = local_session("*", shuffle_partitions=8, app_name="roilens-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark, tmp_path):
    """A fresh folder for writes (tests run locally, so a temp folder is the shared folder)."""
    return str(tmp_path)
