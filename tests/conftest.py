import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from msgaudit.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="msgaudit-test-ckpt-")
    s = build_session("local[8]", 8, app_name="msgaudit-tests", extra={"spark.checkpoint.dir": ckpt})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def one_col(spark):
    def make(values, name="s"):
        return spark.createDataFrame([(v,) for v in values], f"{name} string")
    return make


def col_values(df, name):
    return [r[name] for r in df.collect()]
