import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples of the named columns."""

    def read(df, *cols):
        return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)

    return read
