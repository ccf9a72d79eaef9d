import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from viewmill.session import local_session, ship

    session = local_session("viewmill-tests", cores="4", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
