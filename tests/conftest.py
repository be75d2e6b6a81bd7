import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tokenmill.session import local_session, shared_dir

    s = local_session("4", shuffle_partitions=8, app="tokenmill-tests")
    shared_dir(s)
    yield s


@pytest.fixture(scope="session")
def small_ctx(spark):
    from tokenmill.plans import corpus as C

    return C.context(spark, SF_SMALL)
