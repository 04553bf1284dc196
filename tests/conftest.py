import os
import tempfile

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{work}/shared")
        .config("spark.sql.warehouse.dir", f"{work}/warehouse")
        .config("spark.local.dir", f"{work}/local")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
