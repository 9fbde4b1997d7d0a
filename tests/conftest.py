import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
