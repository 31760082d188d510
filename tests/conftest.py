import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from shortlist.session import get_session
    s = get_session("local[4]", 4, app_name="shortlist-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shortlist-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from oracle_harness import SMALL
    from shortlist.plans.registry import Tables
    return Tables(spark, SMALL)
