import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from evalframe.session import RECOMMENDED_CONF
    b = SparkSession.builder.master("local[4]").appName("evalframe-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    # tests only: a private checkpoint folder when none is configured
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evalframe-test-ckpt-"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF_SMALL = "/root/testdata/sf0.001"
