import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession


def pytest_collection_finish(session):
    """Stand-in models live in test modules, which the workers of a session made by others cannot import: they travel by value."""
    here = Path(__file__).resolve().parent
    for module in list(sys.modules.values()):
        file = getattr(module, "__file__", None)
        if file and here in Path(file).resolve().parents:
            cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
