import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from termloom.session import session, ship

    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    ship(s)
    return s
