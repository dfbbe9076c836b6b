import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app="evalspark-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="evalspark-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def views(spark):
    from evalspark.sources.views import Views

    return Views(spark, SF001)
