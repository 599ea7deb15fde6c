import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracemill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Value of a column expression over one row of named values."""

    def run(expression, schema=None, **values):
        if values:
            frame = spark.createDataFrame([tuple(values.values())], schema or list(values))
        else:
            frame = spark.range(1)
        return frame.select(expression.alias("out")).first()["out"]

    return run
