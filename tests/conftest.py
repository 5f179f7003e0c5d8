import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    shared = tempfile.mkdtemp(prefix="millrace-tests-")
    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "3g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    yield session
    session.stop()
