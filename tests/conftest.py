import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Rows (series_id, time, value) from values at a step in seconds."""

    def make(values, step=3600, start="2020-01-01 00:00:00", name="a", column="value"):
        rows = [(name, i, None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"series_id string, i int, {column} double")
        return df.selectExpr("series_id", f"timestamp_seconds(unix_timestamp(timestamp'{start}') + i * {step}) AS time", column)

    return make


def column(df, name, order="time"):
    return [r[name] for r in df.orderBy(order).collect()]
