import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pitchside.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    # Tests run on one machine: use a private checkpoint folder unless one is configured.
    if not s.sparkContext.getConf().get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pitchside-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def star001(spark):
    from pitchside.sources.fixtures import fixture_star
    return fixture_star(spark, SF001)
