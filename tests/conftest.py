import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rowsync.session import build_session
    ckpt = tempfile.mkdtemp(prefix="rowsync-test-")
    s = build_session("local[*]", 8, app_name="rowsync-tests", extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from oracle import duck
    return duck(SF01)


@pytest.fixture(scope="session")
def duck001():
    from oracle import duck
    return duck(SF001)
