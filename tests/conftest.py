from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shiprisk.session import build_session
    s = build_session(master="local[4]", app="shiprisk-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.exists(f"{SMOKE}/lineitem.parquet"):
        pytest.skip("test data not present")
    return SMOKE
