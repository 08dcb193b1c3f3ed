"""Every registered query with an SQL counterpart gives the same rows."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.oracle import SQL
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, FOLDER, name) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {
    "train_issue_classifier", "predict_issue", "train_resolution_model", "predict_resolution", "save_models"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
