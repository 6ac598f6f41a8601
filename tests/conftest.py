from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from arcweave.sources.session import build_session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    session = build_session("arcweave-tests", master="local[4]", shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
