import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from gaugeworks.session import build_session

    s = build_session(
        "tests", f"local[{os.cpu_count()}]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
