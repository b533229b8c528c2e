import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stacklens.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "stacklens-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def ctx(spark):
    from stacklens.plans.context import Context
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return Context(spark, SF)


def rows(df):
    return [tuple(r) for r in df.collect()]
