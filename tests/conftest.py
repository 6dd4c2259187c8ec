import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from haulage.session import get_session
    s = get_session("local[4]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                      "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture()
def scratch(spark):
    from haulage.plans.export import scratch_folder
    return scratch_folder(spark, "tests")
