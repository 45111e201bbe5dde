import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from framewright.plans.tables import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression on one row."""

    def run(column):
        return spark.range(1).select(column.alias("x")).collect()[0].x

    return run
