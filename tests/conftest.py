import pytest
from pyspark.sql import SparkSession

from tarnwick.session import workers_see_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "2g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("OFF")
    own.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    workers_see_package(own)
    return own
