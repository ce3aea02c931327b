import logging
import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

# Columns need a running session, and some test tables are built at import.
_SPARK = (
    SparkSession.builder.master("local[8]")
    .appName("sluicework-tests")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "8g")
    .getOrCreate()
)
_SPARK.sparkContext.setLogLevel("OFF")
logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)


@pytest.fixture(scope="session")
def spark():
    yield _SPARK
    _SPARK.stop()
