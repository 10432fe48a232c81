import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import get_session, ship

    s = get_session("lectern-tests", cores=4, shuffle=4, memory="4g")
    ship(s)
    yield s
    s.stop()
