from __future__ import annotations

import os
import tempfile

import pytest

from millrace.session import local_session
from tests.oracle import connect

SMALL = os.environ.get("MILLRACE_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="millrace-test-")
    session = local_session(
        "millrace-tests", 4, **{"spark.checkpoint.dir": scratch, "spark.sql.warehouse.dir": scratch + "/wh"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def rows():
    """Sorted tuples of a frame, optionally of some columns."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
