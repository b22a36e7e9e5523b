"""Every registered query against its SQL oracle."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry_file
from leadflow.plans.oracles import oracles
from leadflow.plans.queries import registered

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered()
ORACLES = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names_agree():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_file.queries()) and set(ORACLES) <= set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_entry(spark):
    profiles = entry_file.entry(spark)
    assert profiles.columns[0] == "lead_id"
    assert profiles.schema["entity"].dataType.names == ["entity_id", "email", "phone", "twitter"]
    assert profiles.count() > 0
