import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a rule to rows of values and return the results in order."""

    def apply(rule, rows, schema):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + schema)
        names = frame.columns[1:]
        got = frame.select("i", rule(*(F.col(name) for name in names)).alias("v")).orderBy("i").collect()
        return [row["v"] for row in got]

    return apply
