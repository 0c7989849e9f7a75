import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gleaner.runtime import clear_scratch  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# Made before the test modules are read, since they name columns.
SESSION = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    clear_scratch(SESSION)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def column(spark):
    """Evaluates a column expression over one row of named values."""

    def run(expression, **values):
        names = list(values) or ["_"]
        row = tuple(values.values()) or (0,)
        schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for n, v in zip(names, row))
        return spark.createDataFrame([row], schema).select(expression.alias("x")).first()[0]

    return run
