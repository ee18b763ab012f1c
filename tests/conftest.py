import pytest
from pyspark.sql import SparkSession


def new_session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("tidewatch-tests")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.shuffle.partitions", "4")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


@pytest.fixture(scope="session")
def spark():
    return new_session()
