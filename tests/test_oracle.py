"""Every query against its SQL equivalent."""

import pytest

import __spark_entry__ as entry
from driftline.plans.catalog import QUERIES
from driftline.plans.oracle import ORACLE
from tests.compare import connect, differences
from tests.conftest import SF01, SF001

WINDOWED = [n for n in QUERIES if "kswin" in n and n != "stream_kswin"] + ["retrain_moments"]  # sf0.001 has no full window, and too few labels


@pytest.fixture(scope="module")
def engines():
    return {d: connect(d) for d in (SF001, SF01)}


def test_every_query_has_an_equivalent():
    assert set(QUERIES) == set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, engines, name):
    sf_dir = SF01 if name in WINDOWED else SF001
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = engines[sf_dir].execute(entry.oracle_sql()[name]).df()
    assert differences(got, want) is None
