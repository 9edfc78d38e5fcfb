import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from framewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def large_plans(spark):
    """Take the plans meant for inputs beyond one task."""
    name = "spark.framewise.smallInputBytes"
    spark.conf.set(name, "0")
    yield
    spark.conf.unset(name)


@pytest.fixture
def table(spark):
    """Table from a schema string and rows. Its size is unknown to Spark, so the plans for large inputs run."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
