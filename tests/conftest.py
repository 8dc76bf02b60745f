import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=8, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(params=["plain", "split"])
def layout(request, spark):
    """Run a test with one window per key, and with hot keys cut into tiny cells and blocks."""
    spark.conf.set("tidemark.layout", request.param)
    spark.conf.set("tidemark.cell.rows", "20")
    spark.conf.set("tidemark.block.rows", "16")
    yield request.param
    for name in ("tidemark.layout", "tidemark.cell.rows", "tidemark.block.rows"):
        spark.conf.unset(name)
