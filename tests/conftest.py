import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL_SF = "/root/testdata/sf0.001"
MID_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import build_session, checkpoint_dir

    s = build_session("local[4]", app_name="shelfwise-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    # Tests own their checkpoint folder (a cluster names a shared one).
    checkpoint_dir(s, local_fallback=True)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shelfwise-test-")
