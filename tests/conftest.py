import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sieveline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column function over texts: ``column(texts, fn) -> list``."""
    from pyspark.sql import functions as F

    def run(texts, fn):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4, "id")
        rows = df.select("id", fn(F.col("text")).alias("v")).orderBy("id").collect()
        return [r.v for r in rows]

    return run
