import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pondus.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.sql.autoBroadcastJoinThreshold": "10485760"})
    checkpoint_dir(s)  # tests set their own checkpoint folder (unset otherwise)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="pondus-test-")
