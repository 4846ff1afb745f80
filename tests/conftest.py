import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from postlens.session import build_session
    s = build_session(master="local[*]", partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="postlens-test-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.exists(f"{SF_SMALL}/orders.parquet"):
        pytest.skip("driver test data not present")
    return SF_SMALL
