import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quire.session import build_session
    s = build_session(cpus=4, shuffle_partitions=8, app="quire-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="quire-test-ckpt-", dir="/tmp")})
    yield s
    s.stop()
