import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

os.environ.setdefault("TOPICLOOM_SHUFFLE", "4")
os.environ.setdefault("TOPICLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from topicloom.session import build_session

    session = build_session("tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session
