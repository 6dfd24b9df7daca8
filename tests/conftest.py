import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


# Made on import: columns at module level need a session.
SESSION = (
    SparkSession.builder.master("local[8]")
    .appName("jobtrail-tests")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.driver.memory", "8g")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.host", "127.0.0.1")
    .config("spark.driver.bindAddress", "127.0.0.1")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def views(spark):
    from jobtrail.sources.views import Views

    return Views(spark, SF)


@pytest.fixture
def evaluate(spark):
    """Evaluate a column expression over rows given as tuples."""

    def run(schema, rows, *columns):
        df = spark.createDataFrame(rows, schema)
        return [tuple(r) for r in df.select(*columns).collect()]

    return run
