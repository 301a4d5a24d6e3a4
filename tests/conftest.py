import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the given tables are not here")
    return path


@pytest.fixture
def comparisons(spark):
    """Hand-written comparison rows: ``make((row_id, post, a, b, choice, split), ...)``."""
    from duelframe.schemas import COMPARISONS

    def make(*rows):
        return spark.createDataFrame(
            [
                (
                    row_id,
                    {"post": post},
                    None if a is None else [{"text": x} for x in (a, b) if x is not ...],
                    choice,
                    split,
                )
                for row_id, post, a, b, choice, split in rows
            ],
            COMPARISONS,
        )

    return make


def task_failure(match):
    """An error raised while a query runs, also when it comes from a subquery."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    return pytest.raises((PySparkException, Py4JJavaError), match=match)
