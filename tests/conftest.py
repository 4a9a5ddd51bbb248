import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowlab.session import build_session

    session = build_session("local[8]", 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture()
def rows(spark):
    """Small DataFrames from tuples."""
    return lambda data, schema: spark.createDataFrame(data, schema)
