import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tagloom.session import local_session

    return local_session(os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4, memory="4g")
