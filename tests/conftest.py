import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# The 4 x 4 matrix of the hand fixture.
HAND = [(1, 2, 1), (1, 4, 5), (2, 1, 2), (2, 2, 3), (3, 4, 4), (4, 1, 2), (4, 3, 3)]


@pytest.fixture(scope="session")
def hand(spark):
    return spark.createDataFrame(HAND, "user_id int, item_id int, rating smallint").persist()


@pytest.fixture(scope="session")
def skewed(spark):
    """One item and one user hold about a third of all ratings each."""
    rows = {(u, 0): (u * 7) % 5 + 1 for u in range(60)}
    rows |= {(0, i): (i * 3) % 5 + 1 for i in range(60)}
    rows |= {(u, (u * u + 7 * k) % 60): (u + k) % 5 + 1 for u in range(1, 60) for k in range(1)}
    data = [(u, i, r) for (u, i), r in rows.items()]
    return spark.createDataFrame(data, "user_id int, item_id int, rating smallint").persist()
