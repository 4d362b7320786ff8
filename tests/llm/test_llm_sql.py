"""The SQL twins of corpus queries, whole results."""

from __future__ import annotations

import pytest
from compare import connect, differences

from skyledger.llm.queries import QUERIES
from skyledger.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []
