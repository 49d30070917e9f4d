"""Queries of this subpackage against their SQL, on whole tables."""

import pytest

from oracle import compare, connect
from scoretables.llm import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op9_near_duplicates"])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) == []
