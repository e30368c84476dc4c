import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def sample(spark):
    """Three answers that are all valid."""
    return survey(spark, [
        (0, "first", "My colleagues help each other and the atmosphere is friendly.", "Finance", "en"),
        (1, "second", "Every week brings more overtime, I am exhausted.", "Logistics", "en"),
        (2, "third", "Nobody told us when trainings take place this year.", "Legal", "en"),
    ])


def survey(spark, rows):
    """Survey rows from (pos, response_id, text[, department[, language]])."""
    full = [tuple(r) + (None,) * (5 - len(r)) + (None,) for r in rows]
    return spark.createDataFrame(
        full,
        "pos long, response_id string, text string, department string, language string, "
        "survey_theme string",
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
