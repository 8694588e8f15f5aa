import os
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [TOP, os.path.join(TOP, "tests"), os.path.join(TOP, "tests", "llm")]

from graphloom.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4, "6g")
    yield s
    s.stop()
