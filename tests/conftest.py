import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from check_oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(partitions=4)
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """Small DataFrame from rows and a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def rows():
    """Rows as sorted tuples."""

    def take(df, *cols):
        got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(got, key=lambda r: tuple((v is not None, str(v)) for v in r))

    return take
