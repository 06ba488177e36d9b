import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
CHECKED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def session_zone(spark):
    """Set the session zone within a test."""

    def use(zone):
        spark.conf.set("spark.sql.session.timeZone", zone)

    yield use
    spark.conf.set("spark.sql.session.timeZone", "UTC")


VALID = (
    '1.2.3.4 - - [10/Sep/2023:12:34:56 +0530] "GET /usr HTTP/1.0" '
    '200 4988 "-" "Mozilla/5.0 (X11)" 1234'
)


@pytest.fixture
def valid_line():
    return VALID


@pytest.fixture
def lines(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "id bigint, value string")

    return make
