import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from treeline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "treeline-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate column functions over a list of strings: evaluate(values, f) -> list of results."""
    from pyspark.sql import functions as F

    def run(values, make):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in rows.orderBy("i").select(make(F.col("v")).alias("x")).collect()]

    return run
