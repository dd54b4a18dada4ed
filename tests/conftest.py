import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from astraloom.session import session

    folder = tmp_path_factory.mktemp("shared")
    yield session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}", "spark.driver.memory": "4g"})


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    return SF
