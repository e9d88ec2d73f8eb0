import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from protoscan.session import ship_package

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # small results would be merged into one partition, and nothing would cross a border
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shape(spark):
    from protoscan.functions.shape import load_table
    from workloads.sequence import shape_table

    return load_table(shape_table(spark))
