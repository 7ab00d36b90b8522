import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyrail import get_session

    base = tmp_path_factory.mktemp("spark")
    session = get_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base}/shared"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
