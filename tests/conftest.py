import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from formbook.operators.skew import SplitRule  # noqa: E402
from formbook.session import tune  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("formbook-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def hot():
    """A rule that treats small keys as heavy, so the split plans run on test data."""
    return SplitRule(hot_rows=40, block_rows=25, check_bytes=0)


@pytest.fixture(scope="session")
def data():
    return DATA
