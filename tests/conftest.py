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
    os.environ.setdefault("TESSERA_LOCAL_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="tessera-test-"))
    from tessera.session import get_session

    s = get_session("local[4]", app="tessera-tests", shuffle_partitions=8)
    yield s
    s.stop()
