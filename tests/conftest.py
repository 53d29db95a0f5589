import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from kairos.session import get_spark
    s = get_spark("local[8]", app="kairos-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="kairos-test-ckpt-")
        s.sparkContext.setCheckpointDir(d)
    yield s
