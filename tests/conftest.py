import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(build_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g"))
    yield session
    session.stop()
