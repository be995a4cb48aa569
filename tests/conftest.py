import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from offerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("tests", cores="4", partitions=4, memory="6g", folder=folder)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows and a schema text to a frame."""
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)
    return build


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
