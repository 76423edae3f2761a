import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="tidemark-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Points of one series, or of (series, ms, value) rows in order of arrival."""
    from pyspark.sql import functions as F

    from tidemark.model import at_micros

    def make(rows):
        rows = [(r if len(r) == 3 else ("s", *r)) for r in rows]
        rows = [(s, s.split(",")[0], dict(x.split("=") for x in s.split(",")[1:]), ms, v, i) for i, (s, ms, v) in enumerate(rows)]
        df = spark.createDataFrame(rows, "series_key string, metric string, tags map<string,string>, ms long, value double, seq long")
        return df.withColumn("ts", at_micros(F.col("ms") * 1000)).select("series_key", "metric", "tags", "ts", "value", "seq")

    return make
