import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ravelin.session import local_session

    # Short jobs: light compilation and few partitions save most of the time.
    SparkSession.builder.config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1").config("spark.sql.codegen.cache.maxEntries", "2000")
    return local_session("8", 2, "tests")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
