from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from verdigris.session import local_session

    scratch = tempfile.mkdtemp(prefix="spark-")
    s = local_session(8, 4, **{"spark.checkpoint.dir": f"file://{scratch}/shared", "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.local.dir": scratch})
    yield s
    s.stop()
