import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tickwise.session import build_session
    shared = str(tmp_path_factory.mktemp("shared"))
    s = build_session("local[*]", app="tickwise-tests", shuffle_partitions=4, extra={"spark.checkpoint.dir": shared, "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
