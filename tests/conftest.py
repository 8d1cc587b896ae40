import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docketlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate columns over one row of strings ``v``."""

    def evaluate(values, *columns):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        rows = df.select(*columns).collect()
        return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]

    return evaluate
