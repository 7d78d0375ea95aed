import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import build_session
    # tests own their scratch folder
    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tallyspark-tests-")})
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
