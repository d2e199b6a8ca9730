import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FRAME = "id long, timestamp double, app_name string, window_title string, text string, extra_context string, phash string, project string, user_id long"


@pytest.fixture(scope="session")
def make_frames(spark):
    """Frames from dicts; what is left out is null, besides a user."""
    names = [c.split()[0] for c in FRAME.split(", ")]

    def make(rows, extra=""):
        rows = [{"user_id": 1, **r} for r in rows]
        every = names + [c.split()[0] for c in extra.split(", ") if c]
        return spark.createDataFrame([tuple(r.get(n) for n in every) for r in rows], FRAME + (", " + extra if extra else ""))

    return make
