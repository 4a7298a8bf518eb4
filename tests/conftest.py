import tempfile

import pytest
from pyspark.sql import SparkSession

from plantlog import configure


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("plantlog-tests")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plantlog-tests-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield configure(s)
    s.stop()


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
