import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shopmetrics.session import build_session
    s = build_session("local[4]", app_name="shopmetrics-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()
