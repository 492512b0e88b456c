import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import STAR_TABLES  # noqa: E402
from tests.fixtures import save_empty, save_golden, save_random  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tallyshop-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.shuffle.accurateBlockSkewedFactor", "5.0")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star_dir():
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    return path


@pytest.fixture(scope="session")
def star_db(star_dir):
    con = duckdb.connect()
    for name in STAR_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{star_dir}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def golden_dir(tmp_path_factory):
    return save_golden(str(tmp_path_factory.mktemp("golden")))


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return save_empty(str(tmp_path_factory.mktemp("empty")))


@pytest.fixture(scope="session")
def random_dir(tmp_path_factory):
    return save_random(str(tmp_path_factory.mktemp("random")), seed=7)


@pytest.fixture(scope="session")
def skewed_dir(tmp_path_factory):
    return save_random(str(tmp_path_factory.mktemp("skewed")), seed=11, hot=True)


@pytest.fixture(scope="session")
def golden(spark, golden_dir):
    from tallyshop import read_tables

    return read_tables(spark, golden_dir)
