import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rollcall.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("rollcall-tests", master="local[8]", partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Chunks of a few rows, so that chunk edges and several blocks occur in small fixtures."""
    spark.conf.set("spark.rollcall.chunkRows", "4")
    yield
    spark.conf.unset("spark.rollcall.chunkRows")
