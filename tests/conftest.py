import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
