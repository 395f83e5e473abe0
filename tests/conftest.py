import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from emberquill.session import build_session

    session = build_session("emberquill-tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no driver tables")
    return str(DATA)
