import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rowscope.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]",
        **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "shared"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
