"""Queries of the text operators against their SQL equivalents."""

import pytest

from driftline.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences
from tests.conftest import SF001


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    got = QUERIES[name](spark, SF001).toPandas()
    assert differences(got, connect(SF001).execute(ORACLE[name]).df()) is None
