import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cladeworks.session import local_session, prepare

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return prepare(s)
