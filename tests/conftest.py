import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("haulscope-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="haulscope-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("HAULSCOPE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tables(spark, folder):
    from haulscope.sources.star_schema import StarSchemaTables

    return StarSchemaTables(spark, folder)


@pytest.fixture()
def rows():
    """First column of each row, or whole rows, as plain Python values."""

    def take(df, *columns):
        picked = df.select(*columns) if columns else df
        found = [tuple(r) for r in picked.collect()]
        return [r[0] for r in found] if len(picked.columns) == 1 else found

    return take
