import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from salesmatch.session import build_session

    warehouse = tempfile.mkdtemp(prefix="salesmatch-wh-")
    s = build_session("local[4]", app_name="salesmatch-tests", shuffle_partitions=4,
                      extra_conf={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
