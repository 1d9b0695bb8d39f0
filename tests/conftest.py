import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from redline.session import build_session
    s = build_session("tests", "local[4]", 4, spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
