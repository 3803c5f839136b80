import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    import oracle

    s = oracle.session(4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    from tidemark.session import ship_package

    ship_package(s)
    yield s
    s.stop()


@pytest.fixture
def tiny_tasks(spark):
    """Force the split plans: a task may hold only a handful of rows per key."""
    spark.conf.set("spark.tidemark.rowsPerTask", "7")
    yield
    spark.conf.unset("spark.tidemark.rowsPerTask")
