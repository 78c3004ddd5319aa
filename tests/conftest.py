import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pulse.session import build_session, checkpoint_dir

    s = build_session("local[*]", 8, app_name="pulse-tests")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)   # set a scratch folder only when the session has none
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="pulse-test-")
