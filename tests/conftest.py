import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tandem.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[8]", "tandem-tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
