import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scoretables.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("scoretables-tests")


@pytest.fixture
def tiny_groups(spark):
    """Makes every group count as huge, so that the blocked passes run."""
    spark.conf.set("scoretables.maxGroupRows", "5")
    yield spark
    spark.conf.unset("scoretables.maxGroupRows")
