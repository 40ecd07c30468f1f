import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veracol.functions.columns import ROW_ID  # noqa: E402
from veracol.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small ordered tables: rows keep the order they are written in."""

    def build(schema, rows):
        numbered = [(*row, position) for position, row in enumerate(rows)]
        return spark.createDataFrame(numbered, f"{schema}, {ROW_ID} bigint").repartition(3)

    return build
