import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cardlens.session import get_session
    s = get_session("local[4]", 8, app_name="cardlens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from cardlens.plans.compare import duckdb_views
    con = duckdb.connect()
    duckdb_views(con, SMALL)
    return con
