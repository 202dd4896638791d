import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reelsignals.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Chunks of three rows, so that every scan crosses chunk borders."""
    from reelsignals.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", 3)
