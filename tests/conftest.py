import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from namesake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions=8,
        spark__driver__memory="8g",
        spark__default__parallelism=8,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
