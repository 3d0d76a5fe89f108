import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = session.build("tests", master="local[8]", shuffle_partitions=4,
                      **{"spark.driver.memory": "6g", "spark.checkpoint.dir": f"{folder}/checkpoints",
                         "spark.sql.warehouse.dir": f"{folder}/warehouse",
                         "spark.local.dir": folder})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
