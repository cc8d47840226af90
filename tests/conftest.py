from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from aisleframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("4", "tests", {"spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples over the named columns, doubles rounded."""
    def read(df, *cols):
        def clean(v):
            return round(v, 9) if isinstance(v, float) else v

        out = [tuple(clean(v) for v in r) for r in df.select(*cols).collect()]
        return sorted(out, key=lambda r: tuple((v is None, str(v) if v is None else v) for v in r))

    return read
