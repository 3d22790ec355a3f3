import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMOKE = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from jobtext.session import build_session

    s = build_session(cores="*", shuffle_partitions=8, app="jobtext-tests", read_partitions=8)
    yield s
    s.stop()
