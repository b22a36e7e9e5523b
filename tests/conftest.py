import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture
def folder(tmp_path):
    """A new folder for one test, as a path text."""
    return str(tmp_path)


@pytest.fixture
def rows(spark):
    """Make a frame from tuples and a DDL text."""
    return lambda values, ddl: spark.createDataFrame(values, ddl)
