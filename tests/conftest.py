import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scrubline.session import local_session
    session = local_session(4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """A one-column table with an ``i`` key: ``column([...], "string")``."""
    def make(values, dtype="string", name="c"):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, f"i int, `{name}` {dtype}")
    return make


def values(df, name="c"):
    return [r[name] for r in df.orderBy("i").collect()]
