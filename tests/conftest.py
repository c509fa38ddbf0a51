import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from framegate.runtime import local_session

    session = local_session("8", "framegate-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
